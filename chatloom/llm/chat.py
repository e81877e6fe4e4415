"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own.

A conversation is formatted once, as a stream of chunks, one per turn. An example is a prefix of that stream:
all turns before an assistant turn as context, then the reply, and only the reply's text is trainable. Examples
therefore share their context: they carry offsets into the stream, and a conversation of any length costs as
much as its turns. `rendered` writes examples out as texts where that is wanted.

The template marks a turn as <|im_start|>role, line feed, text, <|im_end|>, line feed. In texts and roles "\\" becomes "\\\\"
and "<|" becomes "<\\|", so that no marker can appear in them; in roles a line feed becomes "\\n". Both are undone on reading.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import schema

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TARGET = "assistant"
#: Turns whose lengths are summed in one window group.
BLOCK = 1024
_CHUNK = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*)" + re.escape(CLOSE) + r"\n", re.S)


def escaped(column: Column) -> Column:
    return F.replace(F.replace(column, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def chunks(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, chunk, loss_start, loss_end): each turn formatted; the loss span is a part of the chunk.

    Null roles and texts are empty. Places are code points; turns without a trainable part have an empty span.
    One row per input row, without a shuffle. Extra columns are ignored.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN), F.replace(escaped(role), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    body = escaped(text)
    start = F.length(head)
    return conversations.select(
        "conv_id", "turn", role.alias("role"), F.concat(head, body, F.lit(CLOSE + "\n")).alias("chunk"),
        start.alias("loss_start"), F.when(role == TARGET, start + F.length(body)).otherwise(start).alias("loss_end"),
    )


def examples(formatted: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, turn, context_end, loss_start, loss_end, example_end): one row per assistant turn of `chunks`.

    Offsets are places in the conversation's stream; an example is the stream up to example_end. Turns are in the
    order of turn (null first), then role and a hash of the chunk, so repeated turns have a fixed order. Lengths are
    summed block by block: a conversation of any length is never one window group.
    """
    sized = formatted.select("conv_id", "turn", "role", "loss_start", "loss_end", F.length("chunk").alias("long"), F.xxhash64("chunk").alias("tie"))
    sized = sized.withColumn("block", F.floor(F.col("turn") / block))
    blocks = sized.groupBy("conv_id", "block").agg(F.sum("long").alias("long"))
    earlier = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("long").over(earlier), F.lit(0)).alias("base"))
    joined = sized.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")))
    order = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "tie")
    before = F.coalesce(F.sum("long").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("base")
    placed = joined.withColumn("context_end", before).where(F.col("role") == TARGET)
    return placed.select("conv_id", "turn", "context_end", (F.col("context_end") + F.col("loss_start")).alias("loss_start"),
                         (F.col("context_end") + F.col("loss_end")).alias("loss_end"), (F.col("context_end") + F.col("long")).alias("example_end"))


def rendered(formatted: DataFrame) -> DataFrame:
    """(conv_id, turn, text, loss_start, loss_end): examples written out, for conversations that fit a cell.

    The output is as large as the sum of all contexts, which grows with the square of a conversation's length.
    """
    order = F.struct("turn", "role", F.xxhash64("chunk").alias("tie"), "chunk")
    stream = formatted.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["chunk"]), "").alias("stream"))
    joined = examples(formatted).join(stream.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")))
    return joined.select("conv_id", "turn", F.substring("stream", F.lit(1), F.col("example_end")).alias("text"), "loss_start", "loss_end")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, counts and digests of its turns and of the trainable text of its `examples`.

    Turns are read from the stream, trainable text from the loss spans of the examples, by their offsets in the stream; an
    example whose context and reply do not end where turns do is an error. A conversation's rows are sorted and streamed
    through one task, which holds one Arrow batch, the spans of one turn number and the digests; a digest of a sequence
    cannot be had otherwise. Conversations with a null conv_id are one.
    """
    fields = [("conv_id", formatted.schema["conv_id"].dataType), ("n_turns", "long"), ("turns_sha256", "string"), ("loss_chars", "long"),
              ("loss_sha256", "string"), ("formatted_chars", "long"), ("n_examples", "long")]
    offsets = ["context_end", "loss_start", "loss_end", "example_end"]

    def run(batches):
        import pyarrow as pa

        kind, current, state, spans = None, None, None, deque()

        def closed():
            if spans:
                raise ValueError(f"conversation {current}: no turn begins where the context of an example ends, at {spans[0][0]}")
            key, turns, loss, n, chars, long, targets = state
            return key, n, turns.hexdigest(), chars, loss.hexdigest(), long, targets

        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("conv_id", "chunk", *offsets)]
            for key, chunk, *span in zip(*columns, strict=True):
                if state is None or key != current:
                    if state is not None:
                        done.append(closed())
                    current, state = key, [key, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0]
                if chunk is None:
                    spans.append(span)
                    continue
                role, text = _CHUNK.fullmatch(chunk).groups()
                state[1].update(f"{unescaped(role)}\n{unescaped(text)}\n".encode())
                begin, state[5] = state[5], state[5] + len(chunk)
                if spans and spans[0][0] == begin:
                    _, start, end, last = spans.popleft()
                    if last != state[5]:
                        raise ValueError(f"conversation {current}: the example at {begin} does not end with its reply")
                    trained = unescaped(chunk[start - begin : end - begin])
                    state[2].update(trained.encode())
                    state[4] += len(trained)
                    state[6] += 1
                state[3] += 1
            if done:
                yield _rows(pa, done, kind, fields)
        if state is not None:
            yield _rows(pa, [closed()], kind, fields)

    # the spans of a turn number come before its turns
    turns = formatted.select("conv_id", "turn", F.lit(1).alias("part"), "role", F.xxhash64("chunk").alias("tie"), "chunk", *[F.lit(None).cast("long").alias(n) for n in offsets])
    nothing = [F.lit(None).cast(turns.schema[n].dataType).alias(n) for n in ("role", "tie", "chunk")]
    targets = examples(formatted).select("conv_id", "turn", F.lit(0).alias("part"), *nothing, *[F.col(n).cast("long") for n in offsets])
    placed = turns.union(targets).repartition("conv_id")
    ordered = placed.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "part", "context_end", "role", "tie", "chunk")
    return ordered.mapInArrow(run, schema(*fields))


def _rows(pa, rows, kind, fields):
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f[0] for f in fields])
