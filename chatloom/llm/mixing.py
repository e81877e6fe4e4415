"""Mixing sources to target weights: documents are counted by exact length, budgets fitted by subset sums.

Lengths are all that matters for a budget, so the corpus is reduced to counts per (source, length). Of every
length a source takes the share that its budget asks for. Shares are rounded in a seeded order of the lengths, up or down
by a seeded draw against the words still owed, so that no length is favoured. The last RESERVE words of a budget, or twice
the longest text, are filled from the counts left over by a bounded-knapsack dynamic programme that finds the best
reachable sum, trying lengths in the same seeded order. Which documents of a length are taken
follows a seeded order; ranks come from counts per hash bucket, so a length that holds a third of all
documents is never ordered in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, schema, staged, with_plain_names

WEIGHTS = (5, 2, 1)
SHARE, MOST_COPIES, SEED = 1.5, 2, 20
#: Words of a budget that are left to the dynamic programme, at least; more where texts are long.
RESERVE = 1 << 13
#: Hash buckets per source and length.
BUCKETS = 256


def targets(totals: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(key, source_size, target) from (key, source, source_size), one row per source.

    Targets are in proportion to weight, none above `most` times its source's size. Sources are capped in
    the order of size per weight: the first that stays below its cap fixes the level of all after it.
    The table has one row per source, which is why its windows have no partitions.
    """
    number = F.row_number().over(Window.orderBy(F.col("source").cast("binary").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(number, F.lit(len(weights))) + 1).cast("int"))
    sized = totals.withColumn("weight", weight).withColumn("cap", most * F.col("source_size").cast("double"))
    rank = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    before, after = rank.rowsBetween(Window.unboundedPreceding, -1), rank.rowsBetween(0, Window.unboundedFollowing)
    whole = share * F.sum("source_size").over(Window.partitionBy())
    level = (whole - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    open_ = sized.withColumn("level", level).withColumn("free", F.col("cap") > F.col("level") * F.col("weight"))
    upto = rank.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = rank.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    settled = open_.withColumn("below", F.max("free").over(upto)).withColumn(
        "common", F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(every)
    )
    target = F.when(F.col("below"), F.col("common") * F.col("weight")).otherwise(F.col("cap"))
    return settled.select("key", "source_size", target.alias("target"))


def best_sum(lengths: np.ndarray, counts: np.ndarray, budget: int, order: np.ndarray | None = None) -> np.ndarray:
    """How many items of each length to take so that their sum comes closest to budget from below.

    Lengths are tried longest first, or in the given order of their places.
    """
    taken = np.zeros(lengths.size, np.int64)
    usable = (lengths > 0) & (lengths <= budget) & (counts > 0)
    fits = np.argsort(-lengths, kind="stable") if order is None else np.asarray(order)
    fits = fits[usable[fits]]
    reached, step = np.zeros(budget + 1, bool), np.full(budget + 1, -1, np.int64)
    reached[0], steps = True, []
    for i in fits:
        rest, lot = min(int(counts[i]), budget // int(lengths[i])), 1
        while rest > 0 and not reached[budget]:  # lots of 1, 2, 4, ... make up any number of this length
            lot = min(lot, rest)
            width = lot * int(lengths[i])
            if width > budget:
                break
            new = np.flatnonzero(reached[: budget + 1 - width] & ~reached[width:]) + width
            reached[new], step[new] = True, len(steps)
            steps.append((i, lot, width))
            rest, lot = rest - lot, 2 * lot
        if reached[budget]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, lot, width = steps[step[at]]
        taken[i] += lot
        at -= width
    return taken


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, total: int, seed: int = SEED) -> np.ndarray:
    """Documents to take of each length so that their words come as near to budget as can be from below."""
    if total <= 0 or budget <= 0:
        return np.zeros(lengths.size, np.int64)
    if budget >= total:
        return counts.copy()
    # the programme gets room for twice the longest text: sources of few texts are fitted by it alone
    goal = budget - min(budget, max(RESERVE, 2 * int(lengths.max())))
    shares = [divmod(int(c) * goal, total) for c in counts]  # exact, also for very large counts
    taken = np.array([whole for whole, _ in shares], np.int64)
    chance, owed = np.random.default_rng(seed), 0.0
    order, draws = chance.permutation(lengths.size).tolist(), chance.random(lengths.size).tolist()
    for i in order:
        length, part = int(lengths[i]), shares[i][1]
        owed += part / total * length
        # a whole share has nothing to round; others go up if the words owed pass a drawn part of the length
        if length > 0 and part and owed >= draws[i] * length:
            taken[i] += 1
            owed -= length
    rest = budget - sum(int(t) * int(n) for t, n in zip(taken, lengths, strict=True))
    while rest < 0:  # the shortest text that is long enough goes, or the longest
        held = np.flatnonzero((taken > 0) & (lengths > 0))
        enough = held[lengths[held] >= -rest]
        i = enough[np.argmin(lengths[enough])] if enough.size else held[np.argmax(lengths[held])]
        taken[i] -= 1
        rest += int(lengths[i])
    return taken + best_sum(lengths, counts - taken, rest, order)


def sizes_of(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): words per document, null texts having none."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def mix(sizes: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for (doc_id, source, size), one row per input row.

    taken is 0, size or 2 size. Every source takes whole passes over all its documents as long as the target
    allows and fills the rest with one more copy of some. A null source is a source of its own, the last one.
    Rows with equal doc_id are documents of their own; ties in the seeded order are between equal rows or
    rows without doc_id, whose choice does not show in the result's counts. No rows give no rows. Reruns agree.
    """
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))
    order = F.xxhash64(F.lit(seed), "doc_id")
    sizes = sizes.select("doc_id", "source", "size", key.alias("key"), order.alias("order"))
    sizes = staged(sizes.withColumn("bucket", F.pmod("order", F.lit(BUCKETS)).cast("int")), "sizes")
    counts = staged(sizes.groupBy("key", "size", "bucket").agg(F.count("*").alias("rows"), F.first("source").alias("source")), "lengths")
    totals = counts.groupBy("key").agg(F.sum(F.col("size") * F.col("rows")).cast("long").alias("source_size"), F.first("source").alias("source"))
    goals = staged(targets(totals, share, weights), "targets")
    # a target within rounding of a whole number of passes is that number
    passes = F.floor(F.col("target") / F.greatest("source_size", F.lit(1)) + 1e-12)
    goals = goals.withColumn("passes", passes).withColumn("rest", F.greatest(F.lit(0), F.round(F.col("target") - F.col("passes") * F.col("source_size"))).cast("long"))
    lengths = counts.groupBy("key", "size").agg(F.sum("rows").alias("rows"))
    asked = lengths.join(goals, "key").select("key", "size", "rows", "source_size", "rest")

    def choose(table):
        import pyarrow as pa

        table = table.sort_by("size")
        size, rows = (table.column(name).to_numpy() for name in ("size", "rows"))
        picks = fit(size, rows, table.column("rest")[0].as_py(), table.column("source_size")[0].as_py())
        return pa.table({"key": table.column("key").cast(pa.string()), "size": pa.array(size, pa.int64()), "picks": pa.array(picks, pa.int64())})

    # one group per source: as many rows as it has different lengths, whatever its documents
    picks = asked.groupBy("key").applyInArrow(choose, schema(("key", "string"), ("size", "long"), ("picks", "long")))
    before = Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    quota = counts.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).join(picks, ["key", "size"])
    quota = quota.withColumn("quota", F.greatest(F.lit(0), F.least("rows", F.col("picks") - F.col("before"))))
    quota = quota.join(goals.select("key", "source_size", "target", "passes"), "key")
    rank = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("order", "doc_id"))
    chosen = sizes.join(quota.drop("rows", "before", "picks", "source"), ["key", "size", "bucket"]).withColumn("rank", rank)
    copies = F.col("passes") + F.when(F.col("rank") <= F.col("quota"), 1).otherwise(0)
    return chosen.select("doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"))


@with_plain_names
def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The rows of `docs` that the mix takes, as often as it takes them, with all columns under their names.

    Documents without words are left out; no rows give no rows.

    A row is found again by doc_id, source and size: where several rows agree in these, each is taken as
    often as the one taken most. Null doc_ids and sources are values like others.
    """
    plan = mix(sizes_of(docs), **settings).where("taken > 0")
    plan = plan.groupBy("doc_id", "source", "size").agg(F.max(F.col("taken") / F.col("size")).cast("int").alias("__copies"))
    plan = plan.select(F.col("doc_id").alias("__doc"), F.col("source").alias("__source"), F.col("size").alias("__size"), "__copies")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & F.col("source").eqNullSafe(F.col("__source")) & (size == F.col("__size"))
    taken = docs.join(plan, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), "__copies")))
    return taken.select(*docs.columns)
