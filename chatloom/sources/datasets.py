"""Readers that turn dataset files into ``path, pos, messages``, and the load entry point."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import MESSAGES_TYPE, SHUFFLE_SEED
from ..functions.text import strip
from ..operators.records import text_messages, to_messages
from ..operators.sampling import limit_samples, seeded_shuffle
from ..session import prepare
from .arrays import read_json_array
from .csvfiles import read_csv_messages
from .files import WHOLE_FILE_BYTES, list_files, place, read_lines
from .folders import shown_files
from .formats import detect_container, detect_format, json_containers
from .samples import sampled_records, with_sample_id
from .textfiles import read_paragraphs, read_text_files


def read_json_records(
    spark: SparkSession, path, container: str, glob=None, recursive=False, whole_file_bytes=WHOLE_FILE_BYTES
) -> DataFrame:
    """``path, pos, value``: JSON text of every record, from arrays or from lines (blank ones left out)."""
    if container == "array":
        return read_json_array(spark, path, glob, recursive, whole_file_bytes)
    lines = place(read_lines(spark, path, glob, recursive))
    return lines.withColumn("value", strip(F.col("value"))).where(F.col("value") != "")


def read_mixed_records(spark: SparkSession, path, glob=None, whole_file_bytes=WHOLE_FILE_BYTES) -> DataFrame:
    """``path, pos, value`` of JSON files each of which holds an array or lines."""
    return _mixed_records(spark, path, glob, whole_file_bytes)[0]


def _mixed_records(spark, path, glob, whole_file_bytes) -> tuple[DataFrame, bool]:
    """The records, and whether they come straight from a line scan."""
    kinds = json_containers(spark, path, glob)
    found = {row["container"] for row in kinds.select("container").distinct().collect()}
    if found == {"array", "lines"}:
        arrays = read_json_array(spark, path, glob, whole_file_bytes=whole_file_bytes, skip_others=True)
        lines = read_json_records(spark, path, "lines", glob)
        return arrays.unionByName(lines.join(kinds.where("container = 'lines'"), "path", "left_semi")), False
    container = "array" if found == {"array"} else "lines"
    return read_json_records(spark, path, container, glob, whole_file_bytes=whole_file_bytes), container == "lines"


def read_sharegpt(spark, path, container="array", glob=None, on_bad="fail", **options) -> DataFrame:
    return to_messages(read_json_records(spark, path, container, glob, **options), "sharegpt", on_bad=on_bad)


def read_alpaca(spark, path, container="array", glob=None, on_bad="fail", **options) -> DataFrame:
    return to_messages(read_json_records(spark, path, container, glob, **options), "alpaca", on_bad=on_bad)


def read_qa(spark, path, container="lines", glob=None, on_bad="fail", **options) -> DataFrame:
    return to_messages(read_json_records(spark, path, container, glob, **options), "jsonl", on_bad=on_bad)


def read_csv(spark, path, glob=None, **options) -> DataFrame:
    rows = read_csv_messages(spark, path, glob, **options)
    if rows.isEmpty():
        raise ValueError(f"no CSV rows in {path}")
    return rows


def read_text(spark, path, glob=None, directory: bool = False, **options) -> DataFrame:
    """One assistant message per paragraph of a file, or per file of a directory."""
    if directory:
        samples = read_text_files(spark, path, glob or "*.txt")
    else:
        samples = read_paragraphs(spark, path, glob, **options)
    return samples.select("path", "pos", text_messages(F.col("value")).cast(MESSAGES_TYPE).alias("messages"))


def _is_directory(spark: SparkSession, path: str) -> bool:
    """A file lists itself only. Spark raises an error when the path does not exist."""
    first = list_files(spark, path, recursive=False).select("path").limit(2).collect()
    if not first:
        raise ValueError(f"nothing to load in {path}")
    return not (len(first) == 1 and first[0]["path"].endswith(path.rstrip("/")))


def _directory_glob(spark, path, fmt: str) -> str:
    """Files of a directory that belong to a format: the usual extension, else the other JSON one."""
    if fmt == "csv":
        return "*.csv"
    usual, other = ("*.jsonl", "*.json") if fmt == "jsonl" else ("*.json", "*.jsonl")
    return other if list_files(spark, path, usual, recursive=False).isEmpty() else usual


def load_dataset(
    spark: SparkSession,
    path: str,
    format: str = "auto",
    max_samples: int | None = None,
    shuffle: bool = True,
    seed: int = SHUFFLE_SEED,
    on_bad: str = "fail",
    whole_file_bytes: int = WHOLE_FILE_BYTES,
) -> DataFrame:
    """``path, pos, messages`` of a dataset file or directory.

    The shuffle is a seeded permutation that depends on the data only, not on
    partitions. ``max_samples`` keeps the first rows after it; None and 0 keep all.
    Files whose names start with ``_`` are loaded too. A shuffled sample is settled on ids: only its own records are parsed, so a bad
    record outside it does not fail the load.
    """
    prepare(spark)
    shown = shown_files(spark, path)
    is_dir = shown.copies is not None or _is_directory(spark, path)
    if is_dir and shown.copies is not None and list_files(spark, path, recursive=False).isEmpty():
        shown.paths = shown.copies  # every file of the folder is hidden
    path = shown.paths
    container, fmt = detect_format(spark, path) if format == "auto" else (None, format)
    glob = _directory_glob(spark, path, fmt) if is_dir and fmt != "text" else None
    scanned, parsed = False, lambda records: records
    if fmt == "csv":
        records = read_csv(spark, path, glob, whole_file_bytes=whole_file_bytes)
    elif fmt == "text":
        options = {} if is_dir else {"whole_file_bytes": whole_file_bytes}
        records, scanned = read_text(spark, path, directory=is_dir, **options), is_dir
    else:
        if is_dir:
            records, scanned = _mixed_records(spark, path, glob, whole_file_bytes)
        else:
            container = container or detect_container(spark, path)
            records, scanned = read_json_records(spark, path, container, whole_file_bytes=whole_file_bytes), container == "lines"
        parsed = lambda records: to_messages(records, fmt, on_bad=on_bad)
    records = shown.restored(records)
    if not shuffle:
        return parsed(limit_samples(records, max_samples, "path", "pos"))
    if max_samples:
        return parsed(sampled_records(records, max_samples, seed, scanned)).drop("place")
    return seeded_shuffle(parsed(with_sample_id(records, scanned)), "sample_id", seed).drop("sample_id")
