"""Numbers, shuffles and samples of the records of a scan, worked out on ids.

A record's id is its file and its number in the file. Records of one split follow each other in one task, so a
running number less the split's first one is the record's number in the split; one row per split carries what earlier
splits of the file hold. No record is shuffled for its number, and a sample shuffles ids only: which ids come first in
the seeded order is settled before any record is parsed, and the records of these ids are picked out of a second scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import SHUFFLE_SEED
from ..operators.sampling import sample_places
from ..session import stored
from .files import sample_id

SPLIT = ("path", "_block")


def scan_ids(records: DataFrame) -> DataFrame:
    """`records` (path, pos, ..) with `sample_id`, the same as ``files.sample_id`` gives.

    They must come straight from a file scan, at most filtered and projected. The table of splits is as long as
    the scan has splits; Spark sends it to all tasks only if its written bytes are few. A split that is cut otherwise
    in the second scan fails the query.
    """
    rows = records.withColumn("_block", F.col("pos.block")).withColumn("_row", F.monotonically_increasing_id())
    splits = rows.groupBy(*SPLIT).agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    earlier = F.sum("_n").over(W.partitionBy("path").orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    splits = stored(splits.select(*SPLIT, "_first", "_n", F.coalesce(earlier, F.lit(0)).alias("_before")), "splits")
    joined = rows.join(splits, list(SPLIT), "left")
    inside = F.col("_row") - F.col("_first")
    failure = F.raise_error(F.lit("split boundaries changed between two scans")).cast("bigint")
    number = F.when((inside >= 0) & (inside < F.col("_n")), F.col("_before") + inside).otherwise(failure)
    named = joined.withColumn("sample_id", F.concat("path", F.lit("#"), number.cast("string")))
    return named.select(*records.columns, "sample_id")


def with_sample_id(records: DataFrame, scanned: bool) -> DataFrame:
    return scan_ids(records) if scanned else sample_id(records)


def sampled_records(records: DataFrame, n: int, seed: int = SHUFFLE_SEED, scanned: bool = True) -> DataFrame:
    """The first `n` of `records` (path, pos, ..) in the seeded order, with their 0-based ``place`` in it, in that order.

    `scanned` says that the records come straight from a file scan. Others are numbered by a window over (path, pos) alone.
    """
    if scanned:
        named = scan_ids(records)
        chosen = stored(sample_places(named.select("sample_id"), "sample_id", n, seed), "sample-ids")
        return named.join(chosen, "sample_id").drop("sample_id").orderBy("place")
    ids = sample_id(records.select("path", "pos"))
    chosen = stored(sample_places(ids, "sample_id", n, seed).select("path", "pos", "place"), "sample-ids")
    return records.join(chosen, ["path", "pos"]).orderBy("place")
