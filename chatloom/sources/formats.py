"""Which dataset format a file holds."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import FORMAT_EXAMPLES, JSON_SPACE, QA_KEY_SETS
from ..functions.jsontext import has_any_keyset, json_keys, parse_record
from ..functions.paths import directory, suffix
from ..functions.text import strip
from ..session import prepare
from .arrays import read_large_json_array
from .files import (
    WHOLE_FILE_BYTES, has_larger_files, list_files, read_lines, read_whole,
)

JSON_GLOB = "*.{json,jsonl}"


def supported_formats(spark: SparkSession) -> DataFrame:
    """``format, example``."""
    return spark.createDataFrame(list(FORMAT_EXAMPLES.items()), "format string, example string")


def record_based_format(container: Column, is_json: Column, keys: Column) -> Column:
    """Format of a file from its container (array or lines) and first record."""
    has = lambda name: F.coalesce(F.array_contains(keys, name), F.lit(False))
    by_keys = F.when(has("messages"), F.lit("sharegpt")).when(has("instruction"), F.lit("alpaca"))
    in_array = by_keys.when(has_any_keyset(keys, QA_KEY_SETS), F.lit("jsonl")).otherwise(F.lit("sharegpt"))
    in_lines = F.when(~F.coalesce(is_json, F.lit(False)), F.lit("text")).otherwise(
        by_keys.otherwise(F.lit("jsonl"))
    )
    return F.when(container == "array", in_array).otherwise(in_lines)


def classify_first(first: DataFrame) -> DataFrame:
    """``path, container, format`` from the first record of every file (path, container, value)."""
    parsed = parse_record(first, "value")
    return parsed.select(
        "path", "container", record_based_format(F.col("container"), F.col("is_json"), json_keys(F.col("value"))).alias("format")
    )


def _first_line(text: Column) -> Column:
    return strip(F.regexp_extract(text, r"^[^\r\n]*", 0))


def _first_rows(rows: DataFrame) -> DataFrame:
    """The first row of every file, found by its number: an aggregate of texts would sort the texts of all files."""
    rows = rows.where("block = 0")
    return rows.join(F.broadcast(rows.groupBy("path").agg(F.min("row").alias("row"))), ["path", "row"])


def first_json_records(
    spark: SparkSession, path, glob: str = JSON_GLOB, recursive: bool = True, whole_file_bytes: int = WHOLE_FILE_BYTES
) -> DataFrame:
    """``path, container, value``: first array element or first line of every JSON file."""
    files = read_whole(spark, path, glob, recursive, up_to=whole_file_bytes)
    is_array = F.startswith(_first_line(F.col("value")), F.lit("["))
    elements = F.from_json("value", "array<string>", {"allowSingleQuotes": "false"})
    first = files.select(
        "path",
        F.when(is_array, F.lit("array")).otherwise(F.lit("lines")).alias("container"),
        F.when(is_array, F.get(elements, F.lit(0))).otherwise(_first_line(F.col("value"))).alias("value"),
    )
    if has_larger_files(spark, path, whole_file_bytes, glob, recursive):
        elements = read_large_json_array(
            spark, path, glob, recursive, whole_file_bytes, on_bad="mark", skip_others=True, first_only=True
        )
        heads = elements.groupBy("path").agg(F.min_by("value", "pos").alias("element"))
        # a line of a large array may be the whole file: only its start is kept
        pieces = read_lines(spark, path, glob, recursive, line_sep="}", larger_than=whole_file_bytes)
        head = F.left(F.ltrim("value", F.lit(JSON_SPACE)), F.lit(1))
        kinds = _first_rows(pieces).select("path", head.alias("head"))
        lines = _first_rows(read_lines(spark, path, glob, recursive, larger_than=whole_file_bytes))
        lines = lines.select("path", F.when(~F.startswith("value", F.lit("[")), strip(F.col("value"))).alias("line"))
        large = kinds.join(lines, "path", "left").join(heads, "path", "left")
        first = first.unionByName(
            large.select(
                "path",
                F.when(F.col("head") == "[", F.lit("array")).otherwise(F.lit("lines")).alias("container"),
                F.when(F.col("head") == "[", F.col("element")).otherwise(F.col("line")).alias("value"),
            )
        )
    return first


def detect_formats(
    spark: SparkSession, path, recursive: bool = True, whole_file_bytes: int = WHOLE_FILE_BYTES
) -> DataFrame:
    """``path, container, format`` of every dataset file below the path."""
    json_files = classify_first(first_json_records(spark, path, JSON_GLOB, recursive, whole_file_bytes))
    others = list_files(spark, path, "*.{csv,txt}", recursive).select(
        "path",
        F.lit("lines").alias("container"),
        F.when(suffix(F.col("path")) == "csv", F.lit("csv")).otherwise(F.lit("text")).alias("format"),
    )
    return json_files.unionByName(others)


def choose_files(listing: DataFrame) -> DataFrame:
    """``dir, path``: the file that decides each directory's format.

    JSON files come first, then CSV, then text; the smallest name wins a tie.
    """
    kind = suffix(F.col("path"))
    rank = F.when(kind.isin("json", "jsonl"), 0).when(kind == "csv", 1).when(kind == "txt", 2)
    return (
        listing.select(directory(F.col("path")).alias("dir"), "path", rank.alias("rank"))
        .where(F.col("rank").isNotNull())
        .groupBy("dir")
        .agg(F.min_by("path", F.struct("rank", "path")).alias("path"))
    )


def detect_format(spark: SparkSession, path: str) -> tuple[str, str]:
    """(container, format) of a file, or of the deciding file of a directory.

    Reads no further than the first record.
    """
    prepare(spark)
    listing = list_files(spark, path, recursive=False)
    chosen = choose_files(listing).agg(F.min("path").alias("path"), F.count("*").alias("n")).first()
    if chosen["n"] == 0:
        target, kind = path, ""
    else:
        target = chosen["path"]
        kind = target.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return "lines", "csv"
    if kind == "txt":
        return "lines", "text"
    first = _first_record(spark, target)
    if first is None:
        return "lines", "text"
    container, value = first
    row = classify_first(spark.createDataFrame([(target, container, value)], "path string, container string, value string")).first()
    return row["container"], row["format"]


def _heads(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """``path, block, row, container`` by the first character of every piece that is not blank."""
    head = F.left(F.ltrim("value", F.lit(JSON_SPACE)), F.lit(1))
    container = F.when(head == "[", "array").otherwise("lines")
    pieces = read_lines(spark, path, glob, line_sep="}").where(head != "")
    return pieces.select("path", "block", "row", container.alias("container"))


def json_containers(spark: SparkSession, path, glob: str | None = None) -> DataFrame:
    """``path, container``: whether each JSON file holds an array or lines."""
    # row and kind in one number: a minimum of numbers needs no sort of all pieces
    kind = F.shiftleft("row", 1) + F.when(F.col("container") == "array", 0).otherwise(1)
    first = _heads(spark, path, glob).groupBy("path", "block").agg(F.min(kind).alias("_kind"))
    first = first.groupBy("path").agg(F.min_by("_kind", "block").alias("_kind"))
    return first.select("path", F.when(F.col("_kind") % 2 == 0, "array").otherwise("lines").alias("container"))


def detect_container(spark: SparkSession, path: str) -> str:
    """Whether one JSON file holds an array or lines; reads no further than its first pieces."""
    head = _heads(spark, path).first()
    return head["container"] if head else "lines"


def _first_record(spark: SparkSession, path: str) -> tuple[str, str | None] | None:
    """(container, text) of a file's first record, reading only as far as its end.

    ``take`` reads splits in file order and stops early; only as many pieces as the
    first element of an array needs come to the driver.
    """
    pieces = read_lines(spark, path, line_sep="}").select("value")
    count = 16
    while True:
        head = [row["value"] for row in pieces.take(count)]
        text = "}".join(head) + ("}" if len(head) == count else "")
        if not head:
            return None
        if not text.split("\n", 1)[0].strip().startswith("["):
            line = read_lines(spark, path).where("block = 0").select("value").first()["value"]
            return "lines", line.strip()
        body = text.lstrip()[1:].lstrip()
        if body.startswith("]"):
            return "array", None
        try:
            _, end = json.JSONDecoder().raw_decode(body)
            return "array", body[:end]
        except json.JSONDecodeError:
            if len(head) < count:
                raise ValueError(f"not a JSON array: {path}") from None
            count *= 4
