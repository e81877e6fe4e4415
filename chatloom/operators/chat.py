"""Chat histories as rows (conversation, turn, role, text).

Texts and message lists are folded along the turns of a conversation in order, with a running state, so a task holds one
result cell and not the rows of a conversation. Prompts repeat the history before them: the turns of a long
conversation are therefore dealt in blocks, and each block starts from the text of all earlier ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import preview
from .folds import ordered_fold
from .records import message
from .render import CHATML, ChatTemplate, is_rendered, segment

BLOCK_TURNS = 256


def _block(turn: str, size: int) -> Column:
    return F.floor(F.col(turn) / size).cast("bigint")


def _in_order(*fields: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(*fields)))


class _Joined:
    """Texts in order as one, with the number of messages and of those left out."""

    def __init__(self, start: str = ""):
        self.parts, self.n, self.dropped = [start], 0, 0

    def take(self, _, text, n, dropped):
        self.parts.append(text or "")
        self.n, self.dropped = self.n + n, self.dropped + dropped
        return ()

    def end(self):
        yield self.n, self.dropped, "".join(self.parts)


class _Listed:
    """Messages in order as one list."""

    def __init__(self):
        self.messages = []

    def take(self, _, role, content):
        self.messages.append({"role": role, "content": content})
        return ()

    def end(self):
        yield (self.messages,)


class _Before:
    """For every text but the first, all texts before it as one."""

    def __init__(self):
        self.before, self.begun = "", False

    def take(self, block, _n, _dropped, text):
        if self.begun:
            yield block, self.before
        self.before, self.begun = self.before + text, True

    def end(self):
        return ()


class _Prompts:
    """A prompt per user turn: what was taken up to it, between the template's start and its generation mark."""

    def __init__(self, template: ChatTemplate):
        self.parts, self.generation = [template.start], template.generation

    def take(self, _late, turn, role, text):
        self.parts.append(text or "")
        if role == "user":
            # earlier turns are joined once, not again for every prompt
            self.parts = ["".join(self.parts)]
            yield turn, self.parts[0] + self.generation

    def end(self):
        return ()


_JOINED = "n_messages bigint, n_dropped bigint, text string"


def fold_text(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    template: ChatTemplate = CHATML, block_turns: int | None = None,
) -> DataFrame:
    """``conv, n_messages, n_dropped, text``: training text of every conversation.

    With ``block_turns`` the turns of a conversation are joined in blocks first, in as many tasks.
    """
    turns = _segments(df, conv, turn, role, text, template)
    if block_turns:
        parts = _parts(turns, conv, block_turns)
        turns = parts.select(conv, F.col("part").alias("_turn"), F.col("text").alias("_text"), "n_messages", "n_dropped")
    start = template.start
    return ordered_fold(turns, [conv], ["_turn", "_text"], lambda: _Joined(start), _JOINED)


def fold_text_parts(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    template: ChatTemplate = CHATML, block_turns: int = BLOCK_TURNS,
) -> DataFrame:
    """``conv, part, n_messages, n_dropped, text``: training text in consecutive parts.

    Joined in order, the parts are the whole text. Use this form where a single
    conversation may outgrow one cell.
    """
    turns = _segments(df, conv, turn, role, text, template)
    parts = _parts(turns, conv, block_turns)
    if not template.start:
        return parts
    # the template's start opens the first part of every conversation
    first = turns.groupBy(conv).agg(F.min("_turn").alias("_least"))
    first = first.select(F.col(conv).alias("_conv"), _block("_least", block_turns).alias("_first"))
    joined = parts.join(first, F.col(conv).eqNullSafe(F.col("_conv")))
    opened = F.when(F.col("part").eqNullSafe(F.col("_first")), F.concat(F.lit(template.start), "text")).otherwise(F.col("text"))
    return joined.withColumn("text", opened).select(*parts.columns)


def _segments(df, conv, turn, role, text, template) -> DataFrame:
    """``conv, _turn, _text, _n, _dropped`` of every turn."""
    return df.select(
        conv, F.col(turn).alias("_turn"), segment(F.col(role), F.col(text), template).alias("_text"), F.lit(1).alias("_n"),
        F.when(is_rendered(F.col(role), template), 0).otherwise(1).alias("_dropped"),
    )


def _parts(turns: DataFrame, conv: str, block_turns: int) -> DataFrame:
    parted = turns.withColumn("part", _block("_turn", block_turns))
    return ordered_fold(parted, [conv, "part"], ["_turn", "_text"], _Joined, _JOINED)


def fold_messages(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """``conv, messages``: turns as one message list."""
    turns = df.select(conv, F.col(turn).alias("_turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    return ordered_fold(turns, [conv], ["_turn", "role", "content"], _Listed, "messages array<struct<role: string, content: string>>")


def turn_prompts(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    template: ChatTemplate = CHATML, block_turns: int = BLOCK_TURNS,
) -> DataFrame:
    """``conv, turn, prompt``: for each user turn the whole history up to it and the generation mark.

    Conversations of several blocks of turns are folded block by block: the blocks' texts are joined, a running text gives
    every block what came before it, and that is its first row when its prompts are made.
    """
    turns = df.select(
        conv, _block(turn, block_turns).alias("_block"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit(template.default_role)).alias("_role"), segment(F.col(role), F.col(text), template).alias("_text"),
    )
    blocks = turns.groupBy(conv).agg(F.min("_block").alias("_low"), F.max("_block").alias("_high"))
    several = blocks.where((F.col("_low") < F.col("_high"))).select(F.col(conv).alias("_conv"))
    rows = turns.select(conv, "_block", F.lit(1).alias("_late"), "turn", "_role", "_text")
    if not several.isEmpty():  # otherwise no block has anything before it
        long = turns.join(several, F.col(conv).eqNullSafe(F.col("_conv")), "left_semi")
        counted = long.select(conv, "_block", "turn", "_text", F.lit(1).alias("_n"), F.lit(0).alias("_dropped"))
        texts = ordered_fold(counted, [conv, "_block"], ["turn", "_text"], _Joined, _JOINED)
        earlier = ordered_fold(texts, [conv], ["_block"], _Before, "_block bigint, before string")
        first = earlier.select(conv, "_block", F.lit(0).alias("_late"), F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"),
                               F.lit(None).cast("string").alias("_role"), F.col("before").alias("_text"))
        rows = rows.unionByName(first)
    kind = turns.schema["turn"].dataType.simpleString()
    prompts = ordered_fold(rows, [conv, "_block"], ["_late", "turn", "_text"], lambda: _Prompts(template), f"turn {kind}, prompt string")
    return prompts.select(conv, "turn", "prompt")


def prompt_spans(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    template: ChatTemplate = CHATML, block_turns: int = BLOCK_TURNS,
) -> DataFrame:
    """``conv, turn, n_messages, history_chars, prompt_chars``: prompts as spans of the training text.

    A user turn's prompt is the first ``history_chars`` characters of its
    conversation's training text plus the generation mark, so this is the
    linear-size form of ``turn_prompts``.
    """
    turns = df.select(
        conv, F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(template.default_role)).alias("_role"),
        _block(turn, block_turns).alias("_block"),
        F.char_length(segment(F.col(role), F.col(text), template)).cast("bigint").alias("_chars"),
    )
    inside = W.partitionBy(conv, "_block").orderBy("turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = turns.withColumn("_n", F.count("*").over(inside)).withColumn("_sum", F.sum("_chars").over(inside))
    blocks = turns.groupBy(conv, "_block").agg(F.count("*").alias("_bn"), F.sum("_chars").alias("_bsum"))
    before = W.partitionBy(conv).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(
        conv, "_block",
        F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_n0"),
        F.coalesce(F.sum("_bsum").over(before), F.lit(0)).alias("_sum0"),
    )
    joined = counted.where(F.col("_role") == "user").join(blocks, [conv, "_block"])
    history = F.col("_sum") + F.col("_sum0") + len(template.start)
    return joined.select(
        conv, "turn", (F.col("_n") + F.col("_n0")).alias("n_messages"), history.alias("history_chars"),
        (history + len(template.generation)).alias("prompt_chars"),
    )


def upsert_system(messages: Column, content) -> Column:
    """Message list with every system message replaced by one in front."""
    content = content if isinstance(content, Column) else F.lit(content)
    others = F.filter(messages, lambda m: ~F.coalesce(m["role"] == "system", F.lit(False)))
    return F.concat(F.array(message("system", content)), others)


def append_turn(messages: Column, role: str, content: Column) -> Column:
    return F.array_append(messages, message(role, content))


def after_clear(
    df: DataFrame, cleared: Column, conv: str = "conv_id", turn: str = "turn", block_turns: int = BLOCK_TURNS
) -> DataFrame:
    """Turns later than the last one at which the history was cleared."""
    turns = df.withColumn("_block", _block(turn, block_turns))
    blocks = turns.groupBy(conv, "_block").agg(F.max(F.when(cleared, F.col(turn))).alias("_last"))
    # one row per block: the last clearing of the conversation reaches all its blocks
    blocks = blocks.withColumn("_last", F.max("_last").over(W.partitionBy(conv)))
    kept = turns.join(blocks, [conv, "_block"])
    return kept.where(F.col("_last").isNull() | (F.col(turn) > F.col("_last"))).drop("_last", "_block")


def history_preview(df: DataFrame, text: str = "text", length: int = 100) -> DataFrame:
    """Replace each text by its first characters and an ellipsis."""
    return df.withColumn(text, preview(F.col(text), length, always=True))


def reassemble(
    df: DataFrame, *keys: str, index: str = "idx", chunk: str = "chunk", block_chunks: int = BLOCK_TURNS
) -> DataFrame:
    """``keys, reply``: streamed chunks joined in order."""
    parts = df.select(*keys, _block(index, block_chunks).alias("_part"), F.col(index).alias("_i"), F.col(chunk).alias("_c"))
    parts = parts.groupBy(*keys, "_part").agg(
        F.array_join(F.transform(_in_order("_i", "_c"), lambda c: c["_c"]), "").alias("_text")
    )
    whole = F.array_join(F.transform(_in_order("_part", "_text"), lambda p: p["_text"]), "")
    return parts.groupBy(*keys).agg(whole.alias("reply"))
