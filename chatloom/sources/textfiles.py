"""Plain text files: paragraphs, whole files and prompt lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from .files import (
    WHOLE_FILE_BYTES, cut_records, has_larger_files, place, position, read_lines, read_whole,
)


def split_paragraphs(text):
    """Blank-line separated parts of a text; CRLF and CR count as line ends."""
    return F.split(unix_lines(text), "\n\n", -1)


def unix_lines(text):
    """CRLF and CR as LF; text without a CR is left alone."""
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def read_paragraphs(
    spark: SparkSession, path, glob: str | None = None, recursive: bool = False,
    whole_file_bytes: int = WHOLE_FILE_BYTES,
) -> DataFrame:
    """``path, pos, value``: stripped paragraphs, empty ones left out.

    In files beyond one split a paragraph is a run of non-empty lines, which
    gives the same samples without holding the file.
    """
    files = read_whole(spark, path, glob, recursive, up_to=whole_file_bytes)
    parts = files.select("path", F.posexplode(split_paragraphs(F.col("value"))).alias("row", "value"))
    parts = parts.select("path", position(0, F.col("row")).alias("pos"), "value")
    if has_larger_files(spark, path, whole_file_bytes, glob, recursive):
        lines = read_lines(spark, path, glob, recursive, larger_than=whole_file_bytes)
        # an empty line ends a run; what it adds to the run's end is stripped
        runs = cut_records(lines, lambda: lambda line: not line, "\n")
        parts = parts.unionByName(runs.select("path", "pos", "value"))
    return parts.withColumn("value", strip(F.col("value"))).where(F.col("value") != "")


def read_text_files(spark: SparkSession, path, glob: str = "*.txt", recursive: bool = False) -> DataFrame:
    """``path, pos, value``: every file is one stripped sample; empty files are left out."""
    files = read_whole(spark, path, glob, recursive)
    text = strip(unix_lines(F.col("value")))
    return files.select("path", position(0, F.lit(0)).alias("pos"), text.alias("value")).where(F.col("value") != "")


def read_nonblank_lines(spark: SparkSession, path, glob=None, recursive=False) -> DataFrame:
    """``path, pos, value``: stripped lines that are not blank."""
    lines = place(read_lines(spark, path, glob, recursive))
    return lines.withColumn("value", strip(F.col("value"))).where(F.col("value") != "")
