"""Tables written out as dataset files, so that the file readers run over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_path, stored
from ..sources.files import PIECES_AT_ONCE
from ..sources.folders import can_open, opened


def stage_lines(df: DataFrame, label: str) -> str:
    """A text line per row of a one-column frame."""
    path = shared_path(df.sparkSession, label)
    df.write.text(path)
    return path


def stage_json(df: DataFrame, label: str) -> str:
    """A JSON object per line, in files with a JSON extension."""
    path = shared_path(df.sparkSession, label)
    df.write.option("ignoreNullFields", True).json(path)
    return path


def stage_arrays(df: DataFrame, label: str) -> str:
    """One JSON array per file from a column of JSON texts: brackets around, commas between."""

    def bracketed(batches):
        import pyarrow as pa

        opened = False
        for batch in batches:
            for begin in range(0, batch.num_rows, PIECES_AT_ONCE):
                lines = batch.column(0).slice(begin, PIECES_AT_ONCE).to_pylist()
                lines = [("," if opened or i else "[") + v for i, v in enumerate(lines)]
                opened = True
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        if opened:
            yield pa.RecordBatch.from_arrays([pa.array(["]"])], ["value"])

    return stage_lines(df.select("value").mapInArrow(bracketed, "value string"), label)


def stage_csv(df: DataFrame, label: str) -> str:
    path = shared_path(df.sparkSession, label)
    df.write.options(header=True, quote='"', escape='"').csv(path)
    return path


def stage_paragraphs(df: DataFrame, label: str) -> str:
    """Texts separated by blank lines."""
    path = shared_path(df.sparkSession, label)
    df.write.option("lineSep", "\n\n").text(path)
    return path


def stage_text_files(df: DataFrame, key: str, label: str) -> str:
    """One text file per row, named after its key, in a folder per task. ``df`` holds the key and ``value``.

    Where only Spark can open the shared folder, its writer makes a folder per key value.
    """
    path = shared_path(df.sparkSession, label)
    if not can_open(path):
        df.select(key, "value").write.partitionBy(key).text(path)
        return path

    def write(batches):
        from collections import Counter

        import pyarrow as pa
        from pyspark import TaskContext

        task, written = TaskContext.get(), Counter()
        system, folder, _ = opened(f"{path}/{task.partitionId():06}")
        system.create_dir(folder, recursive=True)
        for batch in batches:
            for of, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                name = f"{key}={'' if of is None else of}.{written[of]}"
                written[of] += 1
                # under a hidden name first: a task that is tried again leaves no half of a file
                begun = f"{folder}/.{name}.{task.taskAttemptId()}"
                with system.open_output_stream(begun) as out:
                    out.write((value.as_py() or "").encode() + b"\n")
                system.move(begun, f"{folder}/{name}.txt")
        yield pa.RecordBatch.from_arrays([pa.array([folder])], ["path"])

    system, first, _ = opened(f"{path}/000000")
    system.create_dir(first, recursive=True)  # without rows no task may run
    stored(df.select(key, "value").mapInArrow(write, "path string"), "written")
    return path


def path_key(path, key: str):
    """Value of the key in a path written by ``stage_text_files``."""
    found = F.regexp_extract(path, rf"/{key}=([^/]*?)(?:\.[0-9]+\.txt$|/)", 1)
    return F.nullif(found, F.lit("")).cast("bigint")


def stage_files(df: DataFrame, folder: str, name: str) -> None:
    """A file per partition, `name` with the partition's number in it: a line per row whose ``value`` is not null."""

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        system, place, _ = opened(f"{folder}/{name.format(TaskContext.get().partitionId())}")
        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(place) as out:
            for batch in batches:
                out.write("".join(f"{v}\n" for v in batch.column(0).drop_null().to_pylist()).encode())
        yield pa.RecordBatch.from_arrays([pa.array([place])], ["path"])

    stored(df.select("value").mapInArrow(write, "path string"), "written")
