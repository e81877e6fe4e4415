"""Seeded order, samples, row numbers and training batches without a one-task window.

The seeded order sorts by md5(seed:id). Its first hex digits are uniform
buckets, so a row's number is (rows in earlier buckets) + (number inside its
bucket), and only one count per bucket is ever brought together. ``id`` must be
unique; equal ids land in one bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import (
    CPU_MAX_SEQ_LENGTH, GRADIENT_ACCUMULATION_STEPS, MAX_STEPS, PER_DEVICE_BATCH_SIZE, SHUFFLE_SEED,
    TRAINER_SEED,
)
from ..session import cut_lineage

# 16**BUCKET_DIGITS counts at most: the size of every broadcast in this module
BUCKET_DIGITS = 4
# larger samples are cut by bucket counts instead of a top-k
TOP_K_ROWS = 10_000


def seeded_key(seed, *ids) -> Column:
    """Hash that decides the order; ``seed`` may be a column."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    parts = [F.col(i).cast("string") if isinstance(i, str) else i.cast("string") for i in ids]
    return F.md5(F.concat_ws(":", seed, *parts))


def seeded_shuffle(df: DataFrame, id_col: str, seed: int = SHUFFLE_SEED) -> DataFrame:
    """A permutation that depends only on the ids and the seed."""
    return df.orderBy(seeded_key(seed, id_col), F.col(id_col))


def _bucket(key: Column) -> Column:
    return F.left(key, F.lit(BUCKET_DIGITS))


def _bucket_offsets(keys: DataFrame) -> DataFrame:
    """``_bucket, _n, _before``: at most 16**BUCKET_DIGITS rows."""
    counts = keys.select(_bucket(F.col("_key")).alias("_bucket")).groupBy("_bucket").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    return counts.select("_bucket", "_n", F.coalesce(earlier, F.lit(0)).alias("_before"))


def seeded_sample(
    df: DataFrame, id_col: str, n: int | None, seed: int = SHUFFLE_SEED, ordered: bool = True
) -> DataFrame:
    """First ``n`` rows of the seeded order; None, 0 and n beyond the data keep every row.

    A large sample takes whole buckets as they are and numbers only the bucket that the
    cut falls into, so without ``ordered`` next to nothing is shuffled.
    """
    if not n:
        return seeded_shuffle(df, id_col, seed) if ordered else df
    if n <= TOP_K_ROWS:
        return seeded_shuffle(df, id_col, seed).limit(n)
    key = seeded_key(seed, id_col)
    offsets = _bucket_offsets(df.select(key.alias("_key"))).where(F.col("_before") < n)
    offsets = offsets.withColumn("_whole", F.col("_before") + F.col("_n") <= n).drop("_n")
    keyed = df.withColumn("_key", key).withColumn("_bucket", _bucket(F.col("_key")))
    keyed = keyed.join(F.broadcast(offsets), "_bucket")
    whole = keyed.where("_whole").drop("_whole", "_key", "_bucket", "_before")
    cut = _number(keyed.where("not _whole").drop("_whole"), id_col, "_number").where(F.col("_number") < n)
    sample = whole.unionByName(cut.drop("_number"))
    return seeded_shuffle(sample, id_col, seed) if ordered else sample


def sample_places(df: DataFrame, id_col: str, n: int, seed: int = SHUFFLE_SEED, name: str = "place") -> DataFrame:
    """Rows whose 0-based number in the seeded order is below ``n``, with that number.

    Later buckets are filtered out before the shuffle: about ``n`` rows and one bucket's are shuffled.
    """
    key = seeded_key(seed, id_col)
    wanted = _bucket_offsets(df.select(key.alias("_key"))).where(F.col("_before") < n).drop("_n")
    keyed = df.withColumn("_key", key).withColumn("_bucket", _bucket(F.col("_key")))
    return _number(keyed.join(F.broadcast(wanted), "_bucket"), id_col, name).where(F.col(name) < n)


def _number(keyed: DataFrame, id_col: str, name: str, by=()) -> DataFrame:
    inside = F.row_number().over(W.partitionBy(*by, "_bucket").orderBy("_key", id_col))
    return keyed.withColumn(name, F.col("_before") + inside - 1).drop("_key", "_bucket", "_before")


def seeded_numbers(df: DataFrame, id_col: str, seed: int = SHUFFLE_SEED, name: str = "number") -> DataFrame:
    """Add the 0-based place of every row in the seeded order."""
    key = seeded_key(seed, id_col)
    offsets = _bucket_offsets(df.select(key.alias("_key"))).drop("_n")
    keyed = df.withColumn("_key", key).withColumn("_bucket", _bucket(F.col("_key")))
    return _number(keyed.join(F.broadcast(offsets), "_bucket"), id_col, name)


def epoch_numbers(df: DataFrame, id_col: str, epochs: int, seed: int, name: str = "number") -> DataFrame:
    """Every row once per epoch, numbered in that epoch's own seeded order."""
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(epochs - 1).cast("bigint"))
    spread = df.withColumn("epoch", F.explode(every))
    key = seeded_key(seed, F.col("epoch"), F.col(id_col))
    keyed = spread.withColumn("_key", key).withColumn("_bucket", _bucket(F.col("_key")))
    counts = keyed.groupBy("epoch", "_bucket").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(W.partitionBy("epoch").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("epoch", "_bucket", F.coalesce(earlier, F.lit(0)).alias("_before"))
    return _number(keyed.join(counts, ["epoch", "_bucket"]), id_col, name, by=("epoch",))


def limit_samples(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """First ``n`` rows in the given order; None and 0 keep every row."""
    if not n:
        return df
    if n <= TOP_K_ROWS:
        return df.orderBy(*order).limit(n)
    first = ordered_numbers(df, *order, name="_number").where(F.col("_number") < n)
    return first.orderBy("_number").drop("_number")


def ordered_numbers(df: DataFrame, *order: str, name: str = "number", partitions: int | None = None) -> DataFrame:
    """Add the 0-based place of every row in the given total order.

    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return row_places(df.repartitionByRange(parts, *order).sortWithinPartitions(*order), name)


def row_places(df: DataFrame, name: str = "number") -> DataFrame:
    """Add the 0-based place of every row in the order the frame has.

    That layout is fixed by a reliable checkpoint, and only the row count of each
    partition is brought together.
    """
    ranged = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
    shift = 33  # monotonically_increasing_id keeps the partition number above this bit
    ranged = ranged.withColumn("_part", F.shiftright("_row", shift))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("_part", F.coalesce(earlier, F.lit(0)).alias("_before"))
    local = F.col("_row") - F.shiftleft(F.col("_part"), shift)
    # one row per partition
    return (
        ranged.join(F.broadcast(counts), "_part")
        .withColumn(name, F.col("_before") + local)
        .drop("_row", "_part", "_before")
    )


def with_progress(df: DataFrame, *order: str) -> DataFrame:
    """Add ``idx`` (0-based), ``number`` (1-based) and ``total``."""
    numbered = ordered_numbers(df, *order, name="idx")
    total = F.lit(numbered.count()).cast("bigint")
    return numbered.withColumn("number", F.col("idx") + 1).withColumn("total", total)


def effective_batch(per_device: int = PER_DEVICE_BATCH_SIZE, accumulation: int = GRADIENT_ACCUMULATION_STEPS) -> int:
    return per_device * accumulation


def cpu_limits(per_device: int, max_length: int) -> tuple[int, int]:
    """Batch size and sequence length on a machine without an accelerator."""
    return min(per_device, 1), min(max_length, CPU_MAX_SEQ_LENGTH)


def log_interval(max_steps: int = MAX_STEPS) -> int:
    return max(1, max_steps // 20)


def batch_plan(
    df: DataFrame,
    id_col: str,
    per_device: int = PER_DEVICE_BATCH_SIZE,
    accumulation: int = GRADIENT_ACCUMULATION_STEPS,
    max_steps: int = MAX_STEPS,
    seed: int = TRAINER_SEED,
) -> DataFrame:
    """``epoch, step, micro_batch, slot, logged`` and the id for every sample a training run reads.

    Each epoch has its own seeded order. The run ends after ``max_steps`` optimizer
    steps, so at most ``max_steps`` times the effective batch of rows come out,
    and data beyond the first epoch's need is cut by bucket counts.
    """
    batch = effective_batch(per_device, accumulation)
    needed = max_steps * batch
    rows = df.select(id_col)
    total = rows.count()
    if total == 0:
        empty = "cast(null as bigint)"
        return rows.selectExpr(
            f"{empty} as epoch", f"{empty} as step", f"{empty} as micro_batch", f"{empty} as slot",
            "false as logged", id_col,
        )
    steps_per_epoch = -(-total // batch)
    epochs = -(-max_steps // steps_per_epoch)
    if epochs == 1:
        # the hash of epoch 0
        first = rows.withColumn("_id", F.concat(F.lit("0:"), F.col(id_col).cast("string")))
        planned = sample_places(first, "_id", needed, seed, "_number").withColumn("epoch", F.lit(0).cast("bigint")).drop("_id")
    else:
        planned = epoch_numbers(rows, id_col, epochs, seed, "_number")
    number = F.col("_number")
    step = F.col("epoch") * steps_per_epoch + F.floor(number / batch)
    interval = log_interval(max_steps)
    return (
        planned.withColumn("step", step.cast("bigint"))
        .where(F.col("step") < max_steps)
        .select(
            "epoch",
            "step",
            F.floor(number / per_device).cast("bigint").alias("micro_batch"),
            (number % per_device).cast("bigint").alias("slot"),
            ((F.col("step") + 1) % interval == 0).alias("logged"),
            id_col,
        )
    )
