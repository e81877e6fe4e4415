"""CSV files with a header; headers may differ from file to file."""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.records import csv_messages, csv_plan
from ..session import cut_lineage
from .files import (
    Chosen, WHOLE_FILE_BYTES, _reader, chosen_only, cut_records, file_path, has_larger_files, list_files, plain_paths, position,
    read_lines, split_summaries,
)

#: Headers of at most so many bytes are shipped to every task.
BROADCAST_BYTES = 32 * 1024 * 1024
#: Lines that the header of a single file is looked for in on the driver.
HEADER_LINES = 16
_QUOTING = {"quote": '"', "escape": '"'}


def read_headers(spark: SparkSession, path, glob=None, recursive=False) -> DataFrame:
    """``path, header``: column names of each file, in order."""
    lines = read_lines(spark, path, glob, recursive).where("block = 0 and value <> ''")
    # found by their numbers: an aggregate of texts would sort the texts of all files
    places = lines.groupBy("path").agg(F.min("row").alias("row"))
    first = lines.join(F.broadcast(places), ["path", "row"]).select("path", F.col("value").alias("line"))
    first = cut_lineage(first.withColumn("_more", _open_after(F.col("line"), False) == 1))
    longer = first.where("_more").select("path")
    first = first.select("path", "line")
    if not longer.isEmpty():
        short = first.join(longer, "path", "left_anti")
        first = cut_lineage(short.unionByName(_long_headers(spark, path, glob, recursive, longer)))
    # as many columns as any header could have
    width = (first.agg(F.max(F.size(F.split("line", ",")))).first()[0]) or 1
    cells = F.from_csv("line", _schema(width), _QUOTING)
    header = F.filter(F.array(*[cells[f"c{i}"] for i in range(width)]), lambda c: c.isNotNull())
    return first.select("path", header.alias("header"))


def _long_headers(spark: SparkSession, path, glob, recursive, wanted: DataFrame) -> DataFrame:
    """``path, line``: headers with line ends in quoted cells, up to the first line that starts outside one."""
    marked = Chosen([path] if isinstance(path, str) else list(path), wanted)
    lines = read_lines(spark, marked, glob, recursive)
    header = _cut_rows(lines, first_only=True).join(wanted, "path", "left_semi")
    return header.select("path", F.col("value").alias("line"))


def _schema(width: int) -> str:
    return ", ".join(f"c{i} string" for i in range(width))


def _cells(width: int) -> Column:
    return F.array(*[F.col(f"c{i}") for i in range(width)])


def _open_after(line: Column, opened: bool) -> Column:
    """1 when a quoted cell is still open at the end of a line that starts inside (``opened``) or outside one.

    A quote opens a cell only at its first character; a doubled quote stays inside.
    """
    quoted = r'[^"]*+(?:""[^"]*+)*+"'
    rest = F.regexp_replace(line, f"^{quoted}", "x") if opened else line
    left = F.regexp_replace(rest, f'(^|,)"{quoted}', "$1x")
    still = F.rlike(left, F.lit('(^|,)"'))
    if opened:
        still = still | ~F.rlike(line, F.lit(f"^{quoted}"))
    return F.when(still, 1).otherwise(0)


_QUOTED = rb'[^"]*+(?:""[^"]*+)*+"'
_CELL, _OPENED, _REST = re.compile(b'(^|,)"' + _QUOTED), re.compile(b'(^|,)"'), re.compile(_QUOTED)


def _state_after(line: bytes, opened: int) -> int:
    """``_open_after`` of a line's bytes."""
    if b'"' not in line:
        return opened
    if opened:
        rest = _REST.match(line)
        if rest is None:
            return 1
        line = b"x" + line[rest.end():]
    return int(_OPENED.search(_CELL.sub(rb"\1x", line)) is not None)


def _row_summary():
    """The state after a split's lines if it starts outside a quoted cell, and if inside one."""
    states = [0, 1]

    def add(line):
        if b'"' in line:
            outside = _state_after(line, states[0])
            states[1] = outside if states[0] == states[1] else _state_after(line, states[1])
            states[0] = outside

    return add, lambda: tuple(states)


def _row_ends(state: int):
    """Whether a row ends with a line; blank lines outside a quoted cell are left out."""
    def step(line):
        nonlocal state
        if not line and not state:
            return None
        state = _state_after(line, state)
        return not state

    return step


def _cut_rows(lines: DataFrame, first_only: bool = False) -> DataFrame:
    """Lines joined to rows: a line starts a row unless a quoted cell is open.

    Each split either fixes the state (whatever it was before), flips it or leaves it. A state is that of the latest
    fixing split, flipped as often as flips follow it.
    """
    splits = split_summaries(lines, _row_summary, "to0 bigint, to1 bigint", "row-splits")
    splits = splits.withColumn("_flip", F.when((F.col("to0") == 1) & (F.col("to1") == 0), 1).otherwise(0))
    by_file = W.partitionBy("path").orderBy("block")
    earlier = by_file.rowsBetween(W.unboundedPreceding, -1)
    splits = splits.withColumn("_flips", F.coalesce(F.sum("_flip").over(earlier), F.lit(0)))
    splits = splits.withColumn("_fixed", F.when(F.col("to0") == F.col("to1"), F.col("to0") - F.col("_flips")))
    start = F.coalesce(F.last("_fixed", ignorenulls=True).over(earlier), F.lit(0)) + F.col("_flips")
    splits = splits.withColumn("state", F.pmod(start, F.lit(2)))
    return cut_records(lines, _row_ends, "\n", splits, ("state",), first_only=first_only)


def _large_rows(spark, path, glob, recursive, larger_than, width) -> DataFrame:
    """Rows of files beyond one split; the header goes with all its lines."""
    rows = _cut_rows(read_lines(spark, path, glob, recursive, larger_than=larger_than)).where("not first")
    parsed = rows.withColumn("_row", F.from_csv("value", _schema(width), {**_QUOTING, "multiLine": "true"}))
    return parsed.select("path", "pos", F.array(*[F.col(f"_row.c{i}") for i in range(width)]).alias("cells"))


def _only_header(spark: SparkSession, path, glob, recursive) -> list[str] | None:
    """Column names when there is a single file; reads little further than its header."""
    files = list_files(spark, path, glob, recursive).select("path").take(2)
    if len(files) != 1:
        return None
    head = [row["value"] + "\n" for row in read_lines(spark, path, glob, recursive).select("value").take(HEADER_LINES)]
    cells = csv.reader(head)
    for header in cells:
        # a header that takes all lines read may go on: read_headers finds its end without bringing lines here
        if header and (cells.line_num < HEADER_LINES or len(head) < HEADER_LINES):
            return header
    return None


def read_rows(
    spark: SparkSession, path, glob=None, recursive=False, whole_file_bytes: int = WHOLE_FILE_BYTES
) -> DataFrame:
    """``path, pos, header, plan, cells``: data rows with the header and column plan of their file."""
    only = _only_header(spark, path, glob, recursive)
    headers = None if only else read_headers(spark, path, glob, recursive)
    width = len(only) if only else headers.agg(F.max(F.size("header"))).first()[0] or 1
    reader = _reader(spark, glob, recursive).schema(_schema(width)).options(**_QUOTING)
    table = chosen_only(reader.csv(plain_paths(path), header=True, multiLine=True), path)
    table = table.where(F.col("_metadata.file_size") <= whole_file_bytes)
    rows = table.select(
        file_path().alias("path"),
        position(0, F.monotonically_increasing_id()).alias("pos"),
        _cells(width).alias("cells"),
    )
    if has_larger_files(spark, path, whole_file_bytes, glob, recursive):
        rows = rows.unionByName(_large_rows(spark, path, glob, recursive, whole_file_bytes, width))
    if only:
        header = F.array(*map(F.lit, only))
        return rows.select("path", "pos", header.alias("header"), csv_plan(header).alias("plan"), "cells")
    # the column plan is worked out once per file
    planned = headers.select("path", "header", csv_plan(F.col("header")).alias("plan"))
    # shipped by the measured bytes of the headers; beyond that, adaptive execution cuts the rows of large files
    names = F.sum(F.octet_length("path") + F.octet_length(F.concat_ws("", "header")) + 32 * F.size("header"))
    small = (headers.agg(names).first()[0] or 0) <= BROADCAST_BYTES
    joined = rows.join(F.broadcast(planned) if small else planned, "path", "left")
    return joined.select("path", "pos", "header", "plan", "cells")


def read_csv_messages(
    spark: SparkSession, path, glob=None, recursive=False, whole_file_bytes: int = WHOLE_FILE_BYTES
) -> DataFrame:
    """``path, pos, messages``."""
    rows = read_rows(spark, path, glob, recursive, whole_file_bytes)
    return rows.select("path", "pos", csv_messages(F.col("plan"), F.col("cells")).alias("messages"))
