"""New dataset and prompt files prepared as they arrive, with the batch projections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.generate import generate_batch
from ..operators.records import csv_messages, csv_plan, text_messages, to_messages
from ..operators.render import CHATML, ChatTemplate, render_training_text, single_prompt
from ..session import prepare, shared_path
from ..sources.arrays import array_items_of
from ..sources.files import WHOLE_FILE_BYTES, file_path
from ..sources.folders import can_open
from ..sources.textfiles import unix_lines
from ..sources.prompts import prompts_from_records


def stream_lines(
    spark: SparkSession, path: str, glob: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """``path, value``: stripped non-blank lines of the files that appear below a path."""
    reader = prepare(spark).readStream
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.text(path).select(file_path().alias("path"), strip(F.col("value")).alias("value"))
    return lines.where(F.col("value") != "")


def stream_messages(
    spark: SparkSession, path: str, fmt: str, glob: str | None = None, on_bad: str = "null",
    files_per_batch: int | None = None,
) -> DataFrame:
    """``path, messages`` of arriving JSON-lines files, or of whole text files (``fmt="text"``).

    By default a bad record keeps its row with null messages, so that one line does not stop the stream.
    """
    if fmt != "text":
        return to_messages(stream_lines(spark, path, glob, files_per_batch), fmt, on_bad=on_bad)
    reader = prepare(spark).readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    files = reader.option("pathGlobFilter", glob or "*.txt").text(path, wholetext=True)
    text = strip(unix_lines(F.col("value")))
    files = files.select(file_path().alias("path"), text.alias("value"))
    return files.where(F.col("value") != "").select("path", text_messages(F.col("value")).alias("messages"))


_LISTED = "path string, modificationTime timestamp, length bigint, content binary"


def stream_array_messages(
    spark: SparkSession, path: str, fmt: str, glob: str | None = None, on_bad: str = "null",
    files_per_batch: int | None = None, whole_file_bytes: int = WHOLE_FILE_BYTES,
) -> DataFrame:
    """``path, messages`` of arriving JSON array files; a task reads a file.

    Files beyond `whole_file_bytes` are read piece by piece. A file of that size that turns out to be no array gives
    its bad record after the elements before it. Where only Spark can open the path, every file is read whole.
    """
    def reader():
        found = prepare(spark).readStream
        if glob:
            found = found.option("pathGlobFilter", glob)
        if files_per_batch:
            found = found.option("maxFilesPerTrigger", files_per_batch)
        return found

    # a file that holds no array is one bad record, which to_messages fails or keeps as a row by on_bad
    bad = F.array(F.lit("not a JSON array"))
    files = reader().text(path, wholetext=True)
    pieces = can_open(path)
    if pieces:
        files = files.where(F.col("_metadata.file_size") <= whole_file_bytes)
    items = F.coalesce(F.from_json("value", "array<string>"), bad)
    elements = files.select(file_path().alias("path"), F.explode(items).alias("value"))
    if pieces:
        listed = reader().format("binaryFile").schema(_LISTED).load(path)
        large = listed.where(F.col("_metadata.file_size") > whole_file_bytes).select(file_path().alias("path"))
        found = array_items_of(large).select("path", F.explode(F.coalesce("items", bad)).alias("value"))
        elements = elements.unionByName(found)
    return to_messages(elements, fmt, on_bad=on_bad)


def stream_csv_messages(
    spark: SparkSession, path: str, header: list[str], glob: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """``path, messages`` of arriving CSV files that share a header."""
    reader = prepare(spark).readStream.schema(", ".join(f"c{i} string" for i in range(len(header))))
    reader = reader.options(header=True, multiLine=True, quote='"', escape='"')
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    plan = csv_plan(F.array(*map(F.lit, header)))
    cells = F.array(*[F.col(f"c{i}") for i in range(len(header))])
    return reader.csv(path).select(file_path().alias("path"), csv_messages(plan, cells).alias("messages"))


def stream_training_text(spark, path, fmt, template: ChatTemplate = CHATML, **options) -> DataFrame:
    """``path, text``: rendered samples of arriving files."""
    return render_training_text(stream_messages(spark, path, fmt, **options), template)


def stream_prompts(spark, path, template: ChatTemplate = CHATML, **options) -> DataFrame:
    """``path, prompt, text``: arriving prompts and what the model is given."""
    prompts = prompts_from_records(stream_lines(spark, path, **options))
    return prompts.withColumn("text", single_prompt(F.col("prompt"), template))


_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def drain(stream: DataFrame, path: str, checkpoint: str | None = None) -> DataFrame:
    """Process everything available into a parquet table and read it back.

    Batches without data are left out: a stream with timers would ask for one after the other without end.
    """
    spark = stream.sparkSession
    checkpoint = checkpoint or shared_path(spark, "stream-state")
    before = spark.conf.get(_EMPTY_BATCHES)
    spark.conf.set(_EMPTY_BATCHES, "false")  # a query keeps the settings it starts with
    try:
        query = (
            stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start(path)
        )
    finally:
        spark.conf.set(_EMPTY_BATCHES, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drain_replies(
    stream: DataFrame, factory: Callable[[], Callable], path: str, prompt: str = "text", checkpoint: str | None = None
) -> DataFrame:
    """Generate a reply for every available prompt; a repeated batch overwrites its own output."""
    spark = stream.sparkSession
    checkpoint = checkpoint or shared_path(spark, "stream-state")

    def write(batch: DataFrame, number: int) -> None:
        generate_batch(batch, factory, prompt).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(path)
