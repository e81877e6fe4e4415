"""The tables as streams: arriving files and chat events, drained into tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chat
from ..operators.render import render_training_text
from ..session import shared_path
from ..streaming.chat import stream_chat
from ..streaming.ingest import (
    drain, drain_replies, stream_array_messages, stream_csv_messages, stream_prompts as prompt_stream,
    stream_training_text,
)
from . import staging
from .records import ALPACA_SQL, alpaca_json, qa_json
from .registry import NL, SQL_GENERATION, query, sql_segment, sql_strip, table

_QUESTION = sql_strip("CASE doc_id % 6 WHEN 4 THEN '0' ELSE text END")
_ANSWER = sql_strip("CASE doc_id % 6 WHEN 4 THEN text WHEN 5 THEN '12' ELSE source END")


@query(f"""
    SELECT {sql_segment("'user'", _QUESTION)} || {sql_segment("'assistant'", _ANSWER)} AS text FROM documents
""")
def stream_ingest(spark, sf):
    """Question/answer files rendered as they arrive, a few files at a time."""
    path = staging.stage_lines(qa_json(table(spark, sf, "documents")).select("value"), "stream-qa")
    stream = stream_training_text(spark, path, "jsonl", files_per_batch=8, on_bad="fail")
    return drain(stream, shared_path(spark, "stream-text")).select("text")


@query(f"""
    SELECT {sql_segment("'user'", sql_strip('text'))} || {sql_segment("'assistant'", 'lang')} AS text FROM documents
""")
def stream_csv(spark, sf):
    """CSV files rendered as they arrive."""
    documents = table(spark, sf, "documents")
    path = staging.stage_csv(documents.selectExpr("lang as answer", "text as question"), "stream-csv")
    samples = stream_csv_messages(spark, path, ["answer", "question"])
    return drain(render_training_text(samples), shared_path(spark, "stream-csv-text")).select("text")


@query(f"""
    SELECT {sql_segment("'user'", "question")} || {sql_segment("'assistant'", "answer")} AS text FROM ({ALPACA_SQL})
""")
def stream_arrays(spark, sf):
    """JSON array files rendered as they arrive."""
    path = staging.stage_arrays(alpaca_json(table(spark, sf, "documents")), "stream-arrays")
    samples = stream_array_messages(spark, path, "alpaca", on_bad="fail")
    return drain(render_training_text(samples), shared_path(spark, "stream-arrays-text")).select("text")


@query(f"""
    SELECT conv_id, {sql_segment("'assistant'", sql_strip(f"string_agg(text, {NL} ORDER BY turn)"))} AS text
    FROM conversations GROUP BY conv_id
""")
def stream_text_files(spark, sf):
    """Whole text files rendered as they arrive."""
    turns = table(spark, sf, "conversations")
    folded = chat.fold_messages(turns)
    texts = folded.select("conv_id", F.array_join(F.transform("messages", lambda m: m["content"]), "\n").alias("value"))
    path = staging.stage_text_files(texts, "conv_id", "stream-files")
    stream = stream_training_text(spark, f"{path}/*", "text")
    rendered = drain(stream, shared_path(spark, "stream-files-text"))
    return rendered.select(staging.path_key(F.col("path"), "conv_id").alias("conv_id"), "text")


def chat_events(spark, sf):
    """The turns as a stream of the given file."""
    schema = table(spark, sf, "conversations").schema
    # as a pattern: a stream of a plain path takes folders only, and the table may be one file or a folder of files
    return spark.readStream.schema(schema).parquet(f"{sf}/conversations.parque[t]")


@query(f"""
    SELECT conv_id, turn, history || {SQL_GENERATION} AS prompt, false AS late FROM (
      SELECT conv_id, turn, role, string_agg({sql_segment("role", "text")}, '') OVER
        (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS history
      FROM conversations)
    WHERE role = 'user'
""")
def stream_chat_prompts(spark, sf):
    """Prompts of chat sessions held as stream state."""
    events = chat_events(spark, sf).select("conv_id", "turn", "role", "text")
    return drain(stream_chat(events), shared_path(spark, "stream-chat"))


@query(f"""
    WITH e AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' AND length(text) > 600 THEN 'clear' ELSE role END AS role, text FROM conversations),
    g AS (SELECT *, count(*) FILTER (WHERE role = 'clear') OVER (PARTITION BY conv_id ORDER BY turn) AS part FROM e)
    SELECT conv_id, turn, history || {SQL_GENERATION} AS prompt, false AS late FROM (
      SELECT conv_id, turn, role, string_agg({sql_segment("role", "text")}, '') OVER
        (PARTITION BY conv_id, part ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS history
      FROM g)
    WHERE role = 'user'
""")
def stream_chat_clear(spark, sf):
    """Chat sessions in which long assistant turns clear the history."""
    cleared = (F.col("role") == "assistant") & (F.char_length("text") > 600)
    role = F.when(cleared, "clear").otherwise(F.col("role"))
    events = chat_events(spark, sf).select("conv_id", "turn", role.alias("role"), "text")
    return drain(stream_chat(events), shared_path(spark, "stream-clear"))


@query(f"""
    SELECT {_QUESTION} AS prompt, {sql_segment("'user'", _QUESTION)} || {SQL_GENERATION} AS text FROM documents
""")
def stream_prompts(spark, sf):
    """Prompts rendered as they arrive."""
    path = staging.stage_lines(qa_json(table(spark, sf, "documents")).select("value"), "stream-prompts")
    return drain(prompt_stream(spark, path), shared_path(spark, "stream-prompts-out")).select("prompt", "text")


def _length_model():
    return lambda prompts: [(p[::-1], len(p)) for p in prompts]


@query(f"""
    SELECT {_QUESTION} AS prompt, reverse({_QUESTION}) AS reply, length({_QUESTION}) AS new_tokens FROM documents
""")
def stream_replies(spark, sf):
    """Replies to arriving prompts from a model that reverses them."""
    path = staging.stage_lines(qa_json(table(spark, sf, "documents")).select("value"), "stream-replies")
    found = drain_replies(prompt_stream(spark, path), _length_model, shared_path(spark, "replies"), prompt="prompt")
    return found.select("prompt", "reply", "new_tokens")
