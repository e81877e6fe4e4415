"""Rendering and chat histories over ``conversations``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chat, render
from .registry import SQL_GENERATION, query, sql_segment, table

_SEGMENT = sql_segment("role", "text")


@query(f"""
    SELECT conv_id, count(*) AS n_messages, string_agg({_SEGMENT}, '' ORDER BY turn) AS text
    FROM conversations GROUP BY conv_id
""")
def render_training_text(spark, sf):
    """Training text of every conversation."""
    return chat.fold_text(table(spark, sf, "conversations")).drop("n_dropped")


@query(f"""
    SELECT conv_id, turn // 4 AS part, count(*) AS n_messages, string_agg({_SEGMENT}, '' ORDER BY turn) AS text
    FROM conversations GROUP BY conv_id, turn // 4
""")
def render_training_parts(spark, sf):
    """Training text in consecutive parts of four turns."""
    return chat.fold_text_parts(table(spark, sf, "conversations"), block_turns=4).drop("n_dropped")


@query("""
    SELECT conv_id, count(*) AS n_messages, string_agg(role || ':' || text, chr(30) ORDER BY turn) AS messages
    FROM conversations GROUP BY conv_id
""")
def fold_messages(spark, sf):
    """Turns folded into a message list."""
    folded = chat.fold_messages(table(spark, sf, "conversations"))
    flat = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\x1e")
    return folded.select("conv_id", F.size("messages").cast("bigint").alias("n_messages"), flat.alias("messages"))


_TURN_PROMPTS = f"""
    SELECT conv_id, turn, history || {SQL_GENERATION} AS prompt FROM (
      SELECT conv_id, turn, role, string_agg({_SEGMENT}, '') OVER
        (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS history
      FROM conversations)
    WHERE role = 'user'
"""


@query(f"""
    WITH t AS (SELECT CASE WHEN conv_id % 3 = 0 THEN -1 ELSE conv_id END AS conv_id, conv_id * 1000 + turn AS turn, role, text FROM conversations)
    SELECT conv_id, count(*) AS n_messages, string_agg({_SEGMENT}, '' ORDER BY turn) AS text,
      string_agg(role || ':' || text, chr(30) ORDER BY turn) AS messages FROM t GROUP BY conv_id
""")
def fold_hot_conversation(spark, sf):
    """Training text and message list where one conversation holds a third of all turns."""
    turns = table(spark, sf, "conversations")
    hot = F.when(F.col("conv_id") % 3 == 0, -1).otherwise(F.col("conv_id"))
    turns = turns.select(hot.cast("bigint").alias("conv_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("turn"), "role", "text")
    flat = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\x1e")
    listed = chat.fold_messages(turns).select("conv_id", flat.alias("messages"))
    return chat.fold_text(turns, block_turns=64).drop("n_dropped").join(listed, "conv_id")


@query(_TURN_PROMPTS)
def chat_turn_prompts(spark, sf):
    """Prompt of every user turn: the whole history up to it."""
    return chat.turn_prompts(table(spark, sf, "conversations"))


@query(_TURN_PROMPTS)
def chat_turn_prompts_blocked(spark, sf):
    """The same prompts, with histories cut into blocks of three turns."""
    return chat.turn_prompts(table(spark, sf, "conversations"), block_turns=3)


@query(f"""
    SELECT conv_id, turn, n_messages, history_chars, history_chars + length({SQL_GENERATION}) AS prompt_chars FROM (
      SELECT conv_id, turn, role,
        count(*) OVER w AS n_messages, CAST(sum(length({_SEGMENT})) OVER w AS BIGINT) AS history_chars
      FROM conversations
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    WHERE role = 'user'
""")
def chat_prompt_spans(spark, sf):
    """Prompts as spans of the training text."""
    return chat.prompt_spans(table(spark, sf, "conversations"), block_turns=3)


_SINGLE = sql_segment("'user'", "text")


@query(f"SELECT item_id, {_SINGLE} || {SQL_GENERATION} AS prompt FROM benchmark")
def single_prompts(spark, sf):
    """Prompt of every benchmark item."""
    return table(spark, sf, "benchmark").select("item_id", render.single_prompt(F.col("text")).alias("prompt"))


@query(f"SELECT doc_id, {_SINGLE} || {SQL_GENERATION} AS prompt FROM documents")
def document_prompts(spark, sf):
    """Prompt of every document."""
    return table(spark, sf, "documents").select("doc_id", render.single_prompt(F.col("text")).alias("prompt"))


@query(f"""
    SELECT doc_id, {sql_segment("'system'", "lang")} || {_SINGLE} || {SQL_GENERATION} AS prompt FROM documents
""")
def system_single_prompts(spark, sf):
    """Single prompts with a system message of their own."""
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.col("lang").alias("content")),
        F.struct(F.lit("user").alias("role"), F.col("text").alias("content")),
    )
    documents = table(spark, sf, "documents")
    return documents.select("doc_id", render.render(messages, add_generation_prompt=True).alias("prompt"))


@query(f"""
    SELECT conv_id, {sql_segment("'system'", "'Answer briefly.'")} || coalesce(string_agg(
      {_SEGMENT}, '' ORDER BY turn) FILTER (WHERE role <> 'system'), '') AS text
    FROM conversations GROUP BY conv_id
""")
def system_upsert(spark, sf):
    """Every conversation with its system prompt replaced or added."""
    folded = chat.fold_messages(table(spark, sf, "conversations"))
    return folded.select("conv_id", render.render(chat.upsert_system(F.col("messages"), "Answer briefly.")).alias("text"))


@query(f"""
    SELECT conv_id, string_agg({_SEGMENT}, '' ORDER BY turn) || {sql_segment("'user'", "'Go on.'")} AS text
    FROM conversations GROUP BY conv_id
""")
def append_user_turn(spark, sf):
    """Every conversation with one more user turn."""
    folded = chat.fold_messages(table(spark, sf, "conversations"))
    longer = chat.append_turn(F.col("messages"), "user", F.lit("Go on."))
    return folded.select("conv_id", render.render(longer).alias("text"))


@query("""
    SELECT conv_id, turn, role, text FROM conversations c
    WHERE turn > coalesce((SELECT max(turn) FROM conversations d
      WHERE d.conv_id = c.conv_id AND d.role = 'assistant' AND length(d.text) > 600), -1)
""")
def clear_history(spark, sf):
    """History left when each long assistant turn clears what came before."""
    turns = table(spark, sf, "conversations")
    cleared = (F.col("role") == "assistant") & (F.char_length("text") > 600)
    return chat.after_clear(turns, cleared).select("conv_id", "turn", "role", "text")


@query("SELECT conv_id, turn, role, left(text, 100) || '...' AS text FROM conversations")
def history_preview(spark, sf):
    """History as the chat shows it."""
    return chat.history_preview(table(spark, sf, "conversations"))


@query(f"""
    SELECT conv_id, string_agg({sql_segment("CASE WHEN turn = 2 THEN 'tool' ELSE role END", "text")}, '' ORDER BY turn) AS text,
      CAST(count(*) FILTER (WHERE turn = 2) AS BIGINT) AS n_dropped
    FROM conversations GROUP BY conv_id
""")
def render_unknown_roles(spark, sf):
    """Messages of a role outside the template are left out and counted."""
    turns = table(spark, sf, "conversations")
    turns = turns.withColumn("role", F.when(F.col("turn") == 2, "tool").otherwise(F.col("role")))
    return chat.fold_text(turns).select("conv_id", "text", "n_dropped")


_TURN_MARKS = "CASE role WHEN 'user' THEN '[INST] ' || text || ' [/INST]' WHEN 'assistant' THEN ' ' || text || '</s>' ELSE '' END"


@query(f"""
    SELECT conv_id, '<s>' || string_agg({_TURN_MARKS}, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id
""")
def render_custom_template(spark, sf):
    """A template of another model family, given as data."""
    template = render.ChatTemplate({"user": ("[INST] ", " [/INST]"), "assistant": (" ", "</s>")}, start="<s>")
    folded = chat.fold_messages(table(spark, sf, "conversations"))
    return folded.select("conv_id", render.render(F.col("messages"), template).alias("text"))


@query("""
    SELECT conv_id, string_agg(upper(role) || '> ' || text, chr(10) ORDER BY turn) AS text
    FROM conversations GROUP BY conv_id
""")
def render_with_function(spark, sf):
    """A user's own renderer over batches of message lists."""
    folded = chat.fold_messages(table(spark, sf, "conversations"))
    return folded.select("conv_id", render.render_with(_tagged, F.col("messages")).alias("text"))


def _tagged(messages):
    return messages.map(lambda ms: "\n".join(f"{m['role'].upper()}> {m['content']}" for m in ms))


@query("SELECT conv_id, turn, text AS reply FROM conversations")
def chunk_reassembly(spark, sf):
    """Replies put together from their streamed chunks."""
    turns = table(spark, sf, "conversations")
    chunks = turns.select("conv_id", "turn", F.posexplode(F.split("text", "(?<= )", -1)).alias("idx", "chunk"))
    return chat.reassemble(chunks, "conv_id", "turn", block_chunks=16)
