"""Near-duplicate vectors: int8 tile products with error bounds, full precision only where it can matter.

Equal vectors of a label are one class. A class lies at some angle to a fixed direction, and two vectors
at cosine >= t are at angles that differ by arccos(t) at most. Each label's classes are therefore dealt into
tiles by that angle (from counts per narrow angle band, so that no label, however large, meets in one task),
and only pairs of tiles within reach become tasks. A task multiplies two tiles of int8 vectors. With
u = s q + e the product of two unit vectors is off by at most |s q| |e'| + |e| |s' q'| + |e| |e'|, where the
norms are those of the very vectors; pairs that this bound cannot rule out are recomputed in float64.

A task returns one row per vector that has links there: their number, and the least vector of its local
component. Vectors that are null, zero, or hold null or non-finite components, vectors without a label and
rows without vec_id link with nothing. Vectors of different length are never compared.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import schema, staged
from .components import component_ids
from .unions import merge

TILE_ROWS = 4096
BANDS = 4096
#: Rows of a tile that are multiplied at a time, and dimensions whose int8 products float32 sums exactly.
BLOCK_ROWS, EXACT_DIMS = 1024, 1024


def _usable(column):
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return column.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(column, lambda x: x != 0)


def _band(column):
    """Which of BANDS equal ranges of angles to a fixed direction a vector falls into."""
    wide = F.transform(column, lambda x: x.cast("double"))
    # the direction's i-th component is sin(i + 1): any fixed direction keeps the bound
    along = F.aggregate(F.transform(wide, lambda x, i: x * F.sin(i + 1.0)), F.lit(0.0), lambda a, x: a + x)
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    size = F.sqrt(F.aggregate(F.transform(wide, lambda x, i: F.pow(F.sin(i + 1.0), 2.0)), F.lit(0.0), lambda a, x: a + x))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), along / (norm * size)))
    return F.floor(F.acos(cosine) / math.pi * BANDS).cast("int")


def unit_int8(vectors: np.ndarray):
    """Unit vectors u, int8 values q, scales s, norms of s q and of u - s q (rounded up)."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scale = np.abs(unit).max(axis=1) / 127
    whole = np.rint(unit / scale[:, None])
    back = whole * scale[:, None]
    slack = 1e-12
    return unit, whole.astype(np.int8), scale, np.linalg.norm(back, axis=1) + slack, np.linalg.norm(unit - back, axis=1) + slack


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    total = 0
    for at in range(0, left.shape[1], EXACT_DIMS):  # float32 holds sums of that many int8 products exactly
        part = slice(at, at + EXACT_DIMS)
        total = total + (left[:, part].astype(np.float32) @ right[:, part].astype(np.float32).T).astype(np.float64)
    return total


def tile_links(vectors: np.ndarray, copies: np.ndarray, split: int, same: bool, threshold: float):
    """Links per vector, whether it has any, and least item per local component.

    The first `split` vectors are one tile and the rest the other; same: there is only one tile.
    """
    norm = np.linalg.norm(vectors, axis=1)
    _, whole, scale, size, error = unit_int8(vectors)
    n = len(vectors)
    links, linked, root = np.zeros(n, np.int64), np.zeros(n, bool), np.arange(n)
    rows, columns = (n, range(0, n)) if same else (split, range(split, n))
    for i in range(0, rows, BLOCK_ROWS):
        a = slice(i, min(rows, i + BLOCK_ROWS))
        for j in range(columns.start, columns.stop, BLOCK_ROWS):
            b = slice(j, min(columns.stop, j + BLOCK_ROWS))
            if same and b.stop <= a.start:
                continue
            near = _products(whole[a], whole[b]) * scale[a, None] * scale[b]
            bound = size[a, None] * error[b] + error[a, None] * size[b] + error[a, None] * error[b] + 1e-9
            p, q = np.nonzero(near + bound >= threshold)
            p, q = p + a.start, q + b.start
            if same:
                p, q = p[p < q], q[p < q]
            for at in range(0, p.size, 1 << 16):
                x, y = p[at : at + (1 << 16)], q[at : at + (1 << 16)]
                cosine = np.einsum("ij,ij->i", vectors[x], vectors[y]) / (norm[x] * norm[y])
                x, y = x[cosine >= threshold], y[cosine >= threshold]
                np.add.at(links, x, copies[y])
                np.add.at(links, y, copies[x])
                linked[x] = linked[y] = True
                merge(root, x, y)
    return links, linked, root


def _tiles(classes: DataFrame, tile_rows: int) -> tuple[DataFrame, DataFrame]:
    """Bands with their first row number and size; tiles with the range of bands they cover."""
    group = ["label", "dims"]
    bands = classes.groupBy(*group, "band").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy(*group).orderBy("band").rowsBetween(Window.unboundedPreceding, -1))
    bands = bands.withColumn("before", F.coalesce(before, F.lit(0)))
    last = F.floor((F.col("before") + F.col("rows") - 1) / tile_rows)
    covered = bands.withColumn("tile", F.explode(F.sequence(F.floor(F.col("before") / tile_rows), last)))
    return bands, covered.groupBy(*group, "tile").agg(F.min("band").alias("low"), F.max("band").alias("high"))


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per input row.

    Rows that link with nothing, for whatever reason, have no links, their own vec_id as component and are
    kept; a null vec_id gives a null component and kept = false. Rows with the same vec_id are vectors of
    their own. No rows give no rows; extra columns are ignored.
    """
    rows = embeddings.select("vec_id", "embedding", "label")
    usable = F.coalesce(_usable(F.col("embedding")), F.lit(False)) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    rows = rows.withColumn("key", F.when(usable, F.concat_ws(":", "label", F.md5(F.col("embedding").cast("string")))))
    classes = (
        rows.where("key is not null").groupBy("key", "label", "embedding")
        .agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
        .withColumn("dims", F.size("embedding"))
    )
    classes = staged(classes.withColumn("band", _band(F.col("embedding"))), "vectors")
    bands, tiles = _tiles(classes, tile_rows)
    reach = math.ceil(math.acos(threshold) / math.pi * BANDS) + 1
    other = tiles.select("label", "dims", F.col("tile").alias("right"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    near = (F.col("right") >= F.col("tile")) & (F.col("low2") - F.col("high") <= reach) & (F.col("low") - F.col("high2") <= reach)
    # one row per pair of tiles: as many rows as tasks
    pairs = tiles.join(other, ["label", "dims"]).where(near).select("label", "dims", F.col("tile").alias("left"), "right")
    sides = F.array_distinct(F.array("left", "right"))
    tasks = staged(pairs.withColumn("tile", F.explode(sides)), "tile-pairs")
    spread = F.floor(F.col("before") + F.pmod(F.xxhash64("key"), F.col("rows")))
    placed = classes.join(bands, ["label", "dims", "band"]).withColumn("tile", F.floor(spread / tile_rows))
    sent = placed.select("label", "dims", "tile", "key", "embedding", "copies").join(tasks, ["label", "dims", "tile"])

    def compare(table):
        import pyarrow as pa

        left, right = table.column("left")[0].as_py(), table.column("right")[0].as_py()
        order = np.argsort(table.column("tile").to_numpy() != left, kind="stable")
        table = table.take(pa.array(order))
        flat = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        vectors = flat.astype(np.float64).reshape(table.num_rows, -1)
        split = int((table.column("tile").to_numpy() == left).sum())
        links, linked, root = tile_links(vectors, table.column("copies").to_numpy(), split, left == right, threshold)
        here = np.flatnonzero(linked)
        keys = table.column("key")
        return pa.table({"key": keys.take(pa.array(here)).cast(pa.string()), "links": pa.array(links[here], pa.int64()),
                         "root": keys.take(pa.array(root[here])).cast(pa.string())})

    found = sent.groupBy("label", "dims", "left", "right").applyInArrow(compare, schema(("key", "string"), ("links", "long"), ("root", "string")))
    found = staged(found, "vector-links")
    per_key = found.groupBy("key").agg(F.sum("links").alias("links"))
    ids = component_ids(classes.select("key", "first"), found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    facts = classes.select("key", "copies").join(per_key, "key", "left").join(ids, "key")
    out = rows.join(facts, "key", "left").select(
        "vec_id",
        F.when(F.col("key").isNull(), 0).otherwise(F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").cast("long").alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
