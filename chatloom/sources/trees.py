"""Catalogues read from folders: the listing, and what the verdicts need of the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import ADAPTER_CONFIG, MODEL_CONFIG
from ..functions.jsontext import parse_record
from ..functions.paths import directory, file_name, relative_name, suffix
from ..functions.text import strip
from ..operators import catalog as c
from .arrays import read_large_json_array
from .csvfiles import read_headers, read_rows
from .files import WHOLE_FILE_BYTES, has_larger_files, list_files, place, read_lines, read_whole
from .folders import ShownFiles, hidden_from_spark, list_tree
from .textfiles import read_paragraphs, unix_lines

PREVIEW_CHARS = 201


def _glob(extension: str) -> str:
    """Case-insensitive file pattern."""
    return "*." + "".join(f"[{ch}{ch.upper()}]" for ch in extension)


def scan_datasets(spark: SparkSession, root: str, whole_file_bytes: int = WHOLE_FILE_BYTES) -> DataFrame:
    """Catalogue of the dataset files below a folder, each with its verdict."""
    return _validated(spark, root, list_datasets(spark, root), whole_file_bytes)


def list_datasets(spark: SparkSession, root: str) -> DataFrame:
    """``path, length, modified, name`` of the dataset files below a folder."""
    # a file lies at most two folders deep; folders that links lead to are listed there as well
    return c.dataset_listing(list_tree(spark, root, 3, once=False), root)


def _validated(spark: SparkSession, root: str, listing: DataFrame, whole_file_bytes: int, some: bool = False) -> DataFrame:
    """Catalogue of the files of `listing`. With `some`, other files below the folder are not opened."""
    shown = ShownFiles(spark, root, listing.where(hidden_from_spark(F.col("name"))))
    if some:
        shown.only(listing)

    def kept(df: DataFrame) -> DataFrame:
        df = shown.restored(df)
        return df.where(c.is_dataset_file(relative_name(F.col("path"), root)))

    kinds = {row["kind"] for row in listing.select(suffix(F.col("path")).alias("kind")).distinct().collect()}
    verdicts = []
    if "jsonl" in kinds:
        lines = kept(place(read_lines(spark, shown.paths, _glob("jsonl"), True)))
        lines = lines.withColumn("value", strip(F.col("value"))).where(F.col("value") != "")
        verdicts.append(c.line_verdicts(lines))
    if "json" in kinds:
        verdicts.append(c.array_verdicts(kept(json_file_facts(spark, shown.paths, _glob("json"), whole_file_bytes))))
    if "csv" in kinds:
        headers = kept(read_headers(spark, shown.paths, _glob("csv"), True))
        rows = kept(read_rows(spark, shown.paths, _glob("csv"), True, whole_file_bytes))
        verdicts.append(c.csv_verdicts(headers, rows))
    if "txt" in kinds:
        paragraphs = kept(read_paragraphs(spark, shown.paths, _glob("txt"), True, whole_file_bytes))
        previews = kept(text_previews(spark, shown.paths, _glob("txt"), whole_file_bytes))
        verdicts.append(c.text_verdicts(paragraphs, previews))
    if not verdicts:
        none = spark.createDataFrame([], "path string, pos bigint, value string")
        verdicts.append(c.line_verdicts(none))  # an empty folder has an empty catalogue
    return c.dataset_catalog(listing, *verdicts)


def json_file_facts(spark, root, glob, whole_file_bytes) -> DataFrame:
    """``path, shape, n, first, utf8`` of every JSON file that is not blank."""
    files = read_whole(spark, root, glob, True, up_to=whole_file_bytes).where(strip(F.col("value")) != "")
    parsed = parse_record(files)
    length = F.json_array_length("value")
    first = F.get(F.from_json("value", "array<string>"), F.lit(0))
    facts = parsed.select(
        "path",
        F.when(~F.col("is_json"), "broken").when(length.isNotNull(), "array")
        .when(F.col("record").isNotNull(), "object").otherwise("other").alias("shape"),
        F.coalesce(length, F.lit(0)).cast("bigint").alias("n"),
        F.struct(first.alias("value")).alias("first"),
        F.is_valid_utf8("value").alias("utf8"),
    )
    if has_larger_files(spark, root, whole_file_bytes, glob, True):
        elements = read_large_json_array(spark, root, glob, True, whole_file_bytes, typed=False, on_bad="mark")
        large = list_files(spark, root, glob).where(F.col("length") > whole_file_bytes).select("path")
        found = large.join(c.array_facts(elements), "path", "left")
        facts = facts.unionByName(found.select(
            "path",
            F.when(F.col("n").isNull() | F.col("broken"), "broken").otherwise("array").alias("shape"),
            F.coalesce("n", F.lit(0)).alias("n"), "first", F.coalesce("utf8", F.lit(True)).alias("utf8"),
        ))
    return facts


def text_previews(spark, root, glob, whole_file_bytes) -> DataFrame:
    """``path, head, utf8``: the start of every text file that is not blank."""
    files = read_whole(spark, root, glob, True, up_to=whole_file_bytes).where(strip(F.col("value")) != "")
    head = F.left(unix_lines(F.col("value")), F.lit(PREVIEW_CHARS))
    previews = files.select("path", head.alias("head"), F.is_valid_utf8("value").alias("utf8"))
    if has_larger_files(spark, root, whole_file_bytes, glob, True):
        lines = read_lines(spark, root, glob, True, larger_than=whole_file_bytes)
        utf8 = lines.groupBy("path").agg(
            F.min(F.is_valid_utf8("value")).alias("utf8"), F.max(strip(F.col("value")) != "").alias("_text")
        ).where("_text")
        # every line has at least its line end, so this many lines reach far enough
        place_in_file = F.row_number().over(W.partitionBy("path").orderBy("row"))
        first = lines.where("block = 0").select("path", "row", F.left("value", F.lit(PREVIEW_CHARS)).alias("v"),
                                                place_in_file.alias("_n"))
        first = first.where(F.col("_n") <= PREVIEW_CHARS).groupBy("path").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "v"))), lambda l: l["v"]), "\n").alias("head")
        )
        previews = previews.unionByName(
            first.join(utf8, "path").select("path", F.left("head", F.lit(PREVIEW_CHARS)).alias("head"), "utf8")
        )
    return previews


def _config_texts(spark: SparkSession, root: str, name: str, files: DataFrame) -> DataFrame:
    """``dir, value`` of the configuration files below a folder, those in folders that Spark hides included."""
    below = files.where(file_name(F.col("path")) == name).select("path", relative_name(F.col("path"), root).alias("name"))
    shown = ShownFiles(spark, root, below.where(hidden_from_spark(F.col("name"))))
    texts = shown.restored(read_whole(spark, shown.paths, f"*{name}", True))
    return texts.where(file_name(F.col("path")) == name).select(directory(F.col("path")).alias("dir"), "value")


def scan_models(spark: SparkSession, root: str, max_depth: int = 3, list_all: bool = True) -> DataFrame:
    """Catalogue of the model folders below a folder; one that several links lead to is listed once."""
    files = list_tree(spark, root, max_depth + 2)
    return c.model_catalog(files, _config_texts(spark, root, MODEL_CONFIG, files), root, max_depth, list_all)


def scan_adapters(spark: SparkSession, root: str, details: bool = True) -> DataFrame:
    """Catalogue of the adapters directly below a folder."""
    files = list_tree(spark, root)
    found = c.adapter_catalog(files, _config_texts(spark, root, ADAPTER_CONFIG, files), root)
    return found if details else found.select("name", "path")


def validation_report(spark: SparkSession, models_root: str, datasets_root: str) -> DataFrame:
    """``section, valid, total`` of both folders."""
    return c.validation_totals(
        models=scan_models(spark, models_root), datasets=scan_datasets(spark, datasets_root)
    )
