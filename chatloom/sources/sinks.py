"""Writers of prepared samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_training_set(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by=(), mode: str = "errorifexists"
) -> None:
    """Write rendered samples as parquet or JSON lines, split by the given columns."""
    if fmt not in ("parquet", "json"):
        raise ValueError(f"unknown sink format {fmt}")
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)


def as_json_lines(df: DataFrame, *columns: str):
    """One JSON object per row, ready for a text sink."""
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))
