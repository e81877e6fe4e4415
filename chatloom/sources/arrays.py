"""Elements of files that hold one JSON array."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import JSON_SPACE
from ..functions.text import strip
from .folders import opened
from .files import (
    WHOLE_FILE_BYTES, cut_records, has_larger_files, position, read_lines, read_whole, split_summaries,
)

BAD_ITEM = -1
_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _items(text, typed: bool):
    """Elements of JSON array text; typed elements stay JSON, others lose the quotes of strings."""
    if typed:
        listed = F.try_parse_json(text).try_cast("array<variant>")
        return F.transform(listed, lambda v: F.to_json(v))
    return F.from_json(text, "array<string>", _JSON)


_ESCAPE = re.compile(rb"(?s)\\.")


def _shape(piece: bytes) -> tuple[int, int, int]:
    """Quotes of a piece, and its opening minus closing brackets if it starts outside a string and if inside."""
    parts = (_ESCAPE.sub(b"", piece) if b"\\" in piece else piece).split(b'"')
    outside, inside = b"".join(parts[0::2]), b"".join(parts[1::2])
    return len(parts) - 1, _balance(outside), _balance(inside)


def _balance(bare: bytes) -> int:
    return bare.count(b"{") + bare.count(b"[") - bare.count(b"}") - bare.count(b"]")


def _array_summary():
    """Quotes, depth for both cases and first character of a split, whose pieces were cut at every closing brace.

    Whether it starts inside a string is known only from what precedes it, so it is summarised for both cases.
    """
    quotes, depths, head = 0, [0, 0], None

    def add(piece):
        nonlocal quotes, head
        if head is None:
            head = piece.lstrip(b" ")[:1].decode("latin-1")
        n, outside, inside = _shape(piece)
        for state in (0, 1):
            # the brace the piece was cut at closes something only outside a string
            depths[state] += (inside if (quotes + state) % 2 else outside) - (1 - (quotes + n + state) % 2)
        quotes += n

    return add, lambda: (quotes, *depths, head)


def _array_ends(state: int, base: int):
    """Whether an element of the top array ends with a piece."""
    inside, depth = state, base

    def step(piece):
        nonlocal inside, depth
        n, out, in_ = _shape(piece)
        depth += in_ if inside else out
        inside = (inside + n) % 2
        depth -= 1 - inside
        return depth == 1 and not inside

    return step


def _array_splits(pieces: DataFrame) -> DataFrame:
    """How every split starts: ``state`` (1 inside a string) and ``base`` (depth), and of its file ``is_array, whole``."""
    splits = split_summaries(pieces, _array_summary, "quotes bigint, d0 bigint, d1 bigint, head string", "array-splits")
    by_file = W.partitionBy("path").orderBy("block")
    splits = splits.withColumn("is_array", F.coalesce(F.first("head").over(by_file) == "[", F.lit(False)))
    earlier = by_file.rowsBetween(W.unboundedPreceding, -1)
    splits = splits.withColumn("state", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    splits = splits.withColumn("d", F.when(F.col("state") == 0, F.col("d0")).otherwise(F.col("d1")))
    splits = splits.withColumn("base", F.coalesce(F.sum("d").over(earlier), F.lit(0)))
    # the piece after the last brace counts a brace that is not there
    return splits.withColumn("whole", F.col("is_array") & (F.sum("d").over(W.partitionBy("path")) == -1))


def _record_items(value, ended, typed: bool = False):
    """Elements in a text that was cut at an element's closing brace, or that follows the last one."""
    # between records stand a comma, the opening bracket and the closing one
    text = strip(value)
    body = F.regexp_replace(text, r"^[\[,]", "")
    complete = F.when(text.rlike(r"^[\[,]"), F.concat(F.lit("["), body, F.lit("}]")))
    # only the text after the last record lacks its closing brace
    rest = F.when(text.rlike(r"(?s)^(\[?\s*\]|[\[,]\s*[^\s\]].*\])$"), F.concat(F.lit("["), body))
    return _items(F.when(ended, complete).otherwise(rest), typed)


READ_BYTES = 4 << 20


def array_items_of(files: DataFrame) -> DataFrame:
    """``path, items``: elements of the array files listed by ``path``, some at a time; null where a file is no array.

    A task reads a file from start to end and holds little more than one record. Unlike ``read_large_json_array`` this
    works on a stream of file names, and it needs a file system that pyarrow can open.
    """
    def cut(batches):
        import pyarrow as pa

        def rows(path, found):
            values, ended = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array([path] * len(found)), pa.array(values, pa.binary()), pa.array(ended)], ["path", "value", "ended"])

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, source, _ = opened(path)
                add, finish = _array_summary()
                step, held, found, size = _array_ends(0, 0), [], [], 0
                for piece, last in _brace_pieces(system, source):
                    add(piece)
                    ends = step(piece)
                    held.append(piece)
                    if ends or last:
                        found.append((b"}".join(held), ends and not last))
                        size, held = size + len(found[-1][0]), []
                    if size > READ_BYTES:
                        yield rows(path, found)
                        found, size = [], 0
                _, depth, _, head = finish()
                if head != "[" or depth != -1:
                    found.append((b"not a JSON array", False))
                yield rows(path, found)

    texts = files.select("path").mapInArrow(cut, "path string, value binary, ended boolean")
    return texts.select("path", _record_items(F.col("value").cast("string"), F.col("ended")).alias("items"))


def _brace_pieces(system, source):
    """(piece, whether it is the last) of a file cut at every closing brace."""
    held = []
    with system.open_input_stream(source) as read:
        while chunk := read.read(READ_BYTES):
            pieces = chunk.split(b"}")
            held.append(pieces[0])
            for piece in pieces[1:]:
                yield b"".join(held), False
                held = [piece]
    yield b"".join(held), True


def read_large_json_array(
    spark: SparkSession, path, glob, recursive, larger_than: int, typed: bool = False, on_bad: str = "fail",
    skip_others: bool = False, first_only: bool = False,
) -> DataFrame:
    """``path, pos, value`` of array files that are cut into splits; with `first_only`, of their first records alone.

    A file that does not parse fails the query or, with ``on_bad="mark"``, gives an element
    with item number -1. Files that do not start as an array fail unless skipped or marked.

    Pieces end at every closing brace; a record is the pieces after the end of the one before.
    """
    pieces = read_lines(spark, path, glob, recursive, line_sep="}", larger_than=larger_than)
    splits = _array_splits(pieces)
    # a file that is no array, or is not closed, is not cut: it would be one record
    records = cut_records(pieces, _array_ends, "}", splits, ("state", "base"), "whole", first_only)
    others = splits.where("not whole and is_array" if skip_others else "not whole").select("path").distinct()
    chosen = _record_items(F.col("value"), F.col("ended"), typed)
    items = F.transform(chosen, lambda v, i: F.struct(i.alias("item"), v.alias("value")))
    if on_bad == "fail":
        failure = F.raise_error(F.concat(F.lit("not a JSON array: "), F.col("path")))
        bad = failure.cast("array<struct<item:int,value:string>>")
    else:
        bad = F.array(F.struct(F.lit(BAD_ITEM).alias("item"), F.lit(None).cast("string").alias("value")))
    records = records.select("path", "pos", F.explode(F.coalesce(items, bad)).alias("e"))
    records = records.unionByName(others.select("path", position(0, F.lit(0)).alias("pos"), F.explode(bad).alias("e")))
    place = position(F.col("pos.block"), F.col("pos.row"), F.col("e.item"))
    return records.select("path", place.alias("pos"), F.col("e.value").alias("value"))


def _small_arrays(files: DataFrame, typed: bool) -> DataFrame:
    """Elements of files that are read whole; anything left over after the array fails."""
    whole = F.json_array_length(F.concat(F.lit("["), F.col("value"), F.lit(",0]"))) == 2
    items = F.when(whole, _items(F.col("value"), typed))
    failure = F.raise_error(F.concat(F.lit("not a JSON array: "), F.col("path"))).cast("array<string>")
    rows = files.select("path", F.posexplode(F.coalesce(items, failure)).alias("item", "value"))
    return rows.select("path", position(0, F.col("item")).alias("pos"), "value")


def read_json_array(
    spark: SparkSession, path, glob=None, recursive=False, whole_file_bytes: int = WHOLE_FILE_BYTES,
    typed: bool = False, skip_others: bool = False,
) -> DataFrame:
    """``path, pos, value``: JSON text of every element of array files.

    Strings lose their quotes unless ``typed``, which in turn does not keep the order of keys.
    A file that does not parse fails the query, and so does one that does not start as an
    array unless ``skip_others``.
    """
    files = read_whole(spark, path, glob, recursive, up_to=whole_file_bytes)
    if skip_others:
        files = files.where(F.startswith(F.ltrim("value", F.lit(JSON_SPACE)), F.lit("[")))
    elements = _small_arrays(files, typed)
    if has_larger_files(spark, path, whole_file_bytes, glob, recursive):
        large = read_large_json_array(
            spark, path, glob, recursive, whole_file_bytes, typed, skip_others=skip_others
        )
        elements = elements.unionByName(large)
    return elements
