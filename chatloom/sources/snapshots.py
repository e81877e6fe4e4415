"""Catalogues that are brought up to date: a ledger of verdicts by (path, length, time), and scans of changed files only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as c
from ..session import stored
from .files import WHOLE_FILE_BYTES
from .trees import _validated, list_datasets

#: Raise it when verdicts change: every file is then validated again.
VERDICT_VERSION = 1
FILE_KEY = ("path", "length", "modified")
_VERDICTS = (
    "format string, valid boolean, sample_count bigint, fields array<string>, first_sample string, "
    "errors array<string>, warnings array<string>"
)
LEDGER_SCHEMA = f"path string, length bigint, modified bigint, {_VERDICTS}, version int, scan string"


def open_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """The ledger's rows, one per file state and version; the table is made if there is none."""
    spark.createDataFrame([], LEDGER_SCHEMA).write.mode("ignore").parquet(ledger)
    return spark.read.schema(LEDGER_SCHEMA).parquet(ledger)


def update_datasets(
    spark: SparkSession, root: str, ledger: str, whole_file_bytes: int = WHOLE_FILE_BYTES, version: int = VERDICT_VERSION
) -> DataFrame:
    """Catalogue of the dataset files below `root`, with ``checked``: whether this scan validated the file.

    Files that the ledger knows in the same length and time keep their verdict and are not opened; new and changed
    ones are validated and appended to the ledger. Files that are gone leave the catalogue, and their rows stay
    behind in the ledger. A scan that fails half-way leaves rows that hold for their file states or none, so it is
    simply run again. A file rewritten in the same length within the clock of its file system goes unnoticed.
    """
    listing = stored(list_datasets(spark, root), "listing")
    known = open_ledger(spark, ledger).where(F.col("version") == version)
    changed = stored(listing.join(known, list(FILE_KEY), "left_anti"), "changed")
    scan = uuid.uuid4().hex
    if not changed.isEmpty():
        found = _validated(spark, root, changed, whole_file_bytes, some=True).join(changed.select("path", "modified"), "path")
        found = found.withColumn("version", F.lit(version)).withColumn("scan", F.lit(scan))
        found.select(*known.columns).write.mode("append").parquet(ledger)
    known = open_ledger(spark, ledger).where(F.col("version") == version)
    # two scans at one time may both have validated a file; their verdicts agree
    verdicts = known.withColumn("checked", F.col("scan") == scan).drop("version", "scan").dropDuplicates(list(FILE_KEY))
    return listing.join(verdicts, list(FILE_KEY)).select(
        "name", "path", "length", c.human_size(F.col("length")).alias("size"), "format", "valid", "sample_count",
        "fields", "first_sample", "errors", "warnings", "checked",
    )
