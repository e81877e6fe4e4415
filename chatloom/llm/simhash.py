"""SimHash near-duplicates: fingerprints are dealt out by vantage-point trees and compared within shards.

Two fingerprints that differ in at most `max_bits` bits differ in at most max_bits // parts bits within
one of `parts` equal ranges of bits. For every range there is one tree: its nodes hold a vantage fingerprint
and a distance, points up to that distance go to the left and the others to the right. A point's home is
one leaf; it also visits every leaf that the triangle inequality cannot rule out (|d - threshold| within
the range's radius), so that every pair of near points meets in the home of either of them. Inside a shard
the same search goes on with trees of its own, and full distances decide.

Equal fingerprints are one point, and a shard returns at most one link per point (to the least point of
its local component), so large groups of copies stay linear.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import schema, staged, texts_of, with_plain_names
from .components import component_ids
from .unions import merge

#: Points per shard aimed at, and comparisons made in one block.
SHARD_POINTS = 16_384
BLOCK_PAIRS = 1 << 22
#: Bounds of the tree that is sent to the tasks: levels, and fingerprints it is made from.
MAX_LEVELS, SAMPLE_PER_LEAF, MAX_SAMPLE = 14, 16, 1 << 18


def fingerprint_bits(text: bytes, words: int) -> int:
    """The 64-bit fingerprint of a text as a signed number."""
    import xxhash

    digest, found = xxhash.xxh64_intdigest, text.lower().split()
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    total, ones = 0, np.zeros(64, np.int64)
    numbers = np.fromiter((digest(s, 42) for s in shingles), "<u8")
    for at in range(0, numbers.size, 1 << 16):  # a bounded bit matrix, however long the text
        part = numbers[at : at + (1 << 16)]
        total += part.size
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, bits): the fingerprint of every text, one row per input row.

    Null and wordless texts have fingerprint zero, shorter texts than a shingle are one shingle.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            bits = pa.array([fingerprint_bits(text, words) for text in texts_of(batch)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), bits], ["doc_id", "bits"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, schema(("doc_id", docs.schema["doc_id"].dataType), ("bits", "long")))


def _masks(parts: int) -> list[int]:
    edges = [64 * i // parts for i in range(parts + 1)]
    return [((1 << b) - 1) & ~((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def _cut(distance: np.ndarray) -> int:
    """The distance that splits points most evenly, the larger ones going right; -1 if they are all equal."""
    values, counts = np.unique(distance, return_counts=True)
    if values.size < 2:
        return -1
    below = np.cumsum(counts)[:-1]
    return int(values[np.argmin(np.abs(below - distance.size / 2))])


def _grow(sample: np.ndarray, mask: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and distances of a full tree, node i having the children 2i + 1 and 2i + 2."""
    points, cuts = np.zeros((1 << levels) - 1, np.uint64), np.full((1 << levels) - 1, 64, np.int64)
    held = {0: sample}
    for node in range(points.size):
        own = held.pop(node)
        if own.size:
            points[node] = own[0]
            distance = np.bitwise_count((own ^ own[0]) & np.uint64(mask)).astype(np.int64)
            cuts[node] = max(_cut(distance), int(distance[0]))
            held[2 * node + 1], held[2 * node + 2] = own[distance <= cuts[node]][::-1], own[distance > cuts[node]]
        else:
            held[2 * node + 1] = held[2 * node + 2] = own
    return points, cuts


def _route(values: np.ndarray, tree, mask: int, radius: int, levels: int):
    """Item, leaf and whether it is the item's home, for every leaf that an item has to visit."""
    item, node, home = np.arange(values.size), np.zeros(values.size, np.int64), np.ones(values.size, bool)
    points, cuts = tree
    for _ in range(levels):
        distance = np.bitwise_count((values[item] ^ points[node]) & np.uint64(mask)).astype(np.int64)
        left, right = distance - radius <= cuts[node], distance + radius > cuts[node]
        near = distance <= cuts[node]
        item, node, home = (
            np.concatenate([item[left], item[right]]),
            np.concatenate([2 * node[left] + 1, 2 * node[right] + 2]),
            np.concatenate([(home & near)[left], (home & ~near)[right]]),
        )
    return item, node - ((1 << levels) - 1), home


def near_blocks(home: np.ndarray, visit: np.ndarray, values: np.ndarray, mask: int, radius: int):
    """Index arrays (of visitors, of home points) whose product holds every pair within the radius."""
    work = [(home, visit)]
    while work:
        home, visit = work.pop()
        if home.size == 0 or visit.size == 0:
            continue
        cut = -1
        if home.size * visit.size > BLOCK_PAIRS:
            vantage = values[home[home.size // 2]]
            of_home = np.bitwise_count((values[home] ^ vantage) & np.uint64(mask)).astype(np.int64)
            cut = _cut(of_home)
        if cut >= 0:
            of_visit = np.bitwise_count((values[visit] ^ vantage) & np.uint64(mask)).astype(np.int64)
            work.append((home[of_home <= cut], visit[of_visit - radius <= cut]))
            work.append((home[of_home > cut], visit[of_visit + radius > cut]))
            continue
        step = max(1, BLOCK_PAIRS // home.size) if home.size <= BLOCK_PAIRS else 1
        for at in range(0, visit.size, step):
            yield visit[at : at + step], home


def shard_links(values: np.ndarray, home: np.ndarray, mask: int, radius: int, max_bits: int):
    """(value, least value of its local component) of the points that have a near point in this shard."""
    values, first = np.unique(values, return_index=True)
    home = home[first]
    root = np.arange(values.size)
    for visit, own in near_blocks(np.flatnonzero(home), np.arange(values.size), values, mask, radius):
        near = np.bitwise_count(values[visit][:, None] ^ values[own][None, :]) <= max_bits
        i, j = np.nonzero(near)
        merge(root, visit[i], own[j])
    moved = np.flatnonzero(root != np.arange(values.size))
    return values[moved], values[root[moved]]


def near_links(points: DataFrame, max_bits: int = 3, parts: int = 2, shard_points: int = SHARD_POINTS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct `bits` within max_bits."""
    n = points.count()
    levels = min(MAX_LEVELS, max(0, math.ceil(math.log2(max(n, 1) / shard_points))))
    wanted = min(MAX_SAMPLE, SAMPLE_PER_LEAF << levels)
    sample = np.array([], np.int64)
    if levels:  # a bounded sample only places the vantage points; every point is routed and compared
        rows = points.orderBy(F.xxhash64("bits"), "bits").limit(wanted)
        sample = rows.toPandas()["bits"].to_numpy(np.int64)
    masks, radius = _masks(parts), max_bits // parts
    trees = [_grow(sample.view(np.uint64), mask, levels) for mask in masks]

    def route(batches):
        import pyarrow as pa

        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for number, (tree, mask) in enumerate(zip(trees, masks, strict=True)):
                item, leaf, home = _route(values, tree, mask, radius, levels)
                for at in range(0, item.size, 1 << 16):
                    some = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((number << levels) + leaf[some]), pa.array(values[item[some]].view(np.int64)), pa.array(home[some])],
                        ["shard", "bits", "home"],
                    )

    def compare(table):
        import pyarrow as pa

        shard = table.column("shard")[0].as_py()
        values = table.column("bits").to_numpy().astype(np.int64).view(np.uint64)
        a, b = shard_links(values, table.column("home").to_numpy(), masks[shard >> levels], radius, max_bits)
        return pa.table({"a": pa.array(a.view(np.int64), pa.int64()), "b": pa.array(b.view(np.int64), pa.int64())})

    routed = points.select("bits").mapInArrow(route, schema(("shard", "long"), ("bits", "long"), ("home", "boolean")))
    return routed.groupBy("shard").applyInArrow(compare, schema(("a", "long"), ("b", "long")))


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 3, shard_points: int = SHARD_POINTS) -> DataFrame:
    """(doc_id, bits, component_id): one row per input row; component_id is the least doc_id reachable.

    Rows with a null doc_id take part as texts; a group that has only such rows has a null component_id.
    Repeated rows stay repeated. No rows give no rows. Extra columns are ignored.
    """
    prints = staged(fingerprints(docs, words), "fingerprints")
    classes = staged(prints.groupBy("bits").agg(F.min("doc_id").alias("first")), "classes")
    links = near_links(classes.select("bits"), max_bits, shard_points=shard_points)
    ids = component_ids(classes.withColumnRenamed("bits", "key"), links)
    return prints.join(ids.withColumnRenamed("key", "bits"), "bits").select("doc_id", "bits", "component_id")


#: Samples per text and shingles per sample: texts of similarity 0.8 share one of 20 samples of 5 with 99.96 % chance.
VIEWS, VIEW_SHINGLES = 20, 5
#: Numbers of 64 bits in the parity map of a set of shingles.
MAP_LONGS = 8
_ODD = (np.arange(1, VIEWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The different hashes of a text's shingles, in order; shorter texts are one shingle, wordless ones have none."""
    import xxhash

    found = text.lower().split()
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), 42)] if found else [], np.uint64)
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), np.uint64))


def sampled_fingerprints(shingles: np.ndarray) -> np.ndarray:
    """The fingerprint of each of VIEWS min-wise samples of a set of shingle hashes."""
    out = np.zeros((VIEWS, 64), np.int64)
    size = min(VIEW_SHINGLES, shingles.size)
    with np.errstate(over="ignore"):
        for view in range(VIEWS if size else 0):
            rank = shingles * _ODD[view]
            rank = (rank ^ (rank >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            sample = np.sort(np.partition(rank, size - 1)[:size])  # the ranks themselves are hashes of the shingles
            out[view] = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * out > size, axis=1, bitorder="little").view("<i8").ravel()


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, same, bits, size, views): a digest of the text's words, its fingerprint, its shingles and its samples' fingerprints."""
    import hashlib

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = texts_of(batch)
            same = [hashlib.blake2b(b" ".join(t.lower().split()), digest_size=16).digest() for t in texts]
            sets = [shingle_set(t, words) for t in texts]
            views = [sampled_fingerprints(x).tolist() for x in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(same, pa.binary()), pa.array([fingerprint_bits(t, words) for t in texts], pa.int64()),
                 pa.array([x.size for x in sets], pa.int64()), pa.array(views, pa.list_(pa.int64()))],
                ["doc_id", "same", "bits", "size", "views"],
            )

    from pyspark.sql import types as T

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, schema(("doc_id", docs.schema["doc_id"].dataType), ("same", "binary"), ("bits", "long"), ("size", "long"), ("views", T.ArrayType(T.LongType()))))


def _alike(pairs: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The rows of `pairs` (a, b: doc_ids) whose texts' shingle sets have at least the given Jaccard similarity."""
    texts = docs.select("doc_id", "text")
    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left")), "a")
    both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right")), "b").select("a", "b", "left", "right")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for one, two in zip(texts_of(batch, "left"), texts_of(batch, "right"), strict=True):
                x, y = shingle_set(one, words), shingle_set(two, words)
                common = np.intersect1d(x, y, assume_unique=True).size
                keep.append(common >= similarity * (x.size + y.size - common) - 1e-9)  # 12 of 15 is 0.8
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType
    return both.mapInArrow(run, schema(("a", kind), ("b", kind)))


def parity_map(shingles: np.ndarray) -> np.ndarray:
    """Bit i tells whether an odd number of shingles falls to place i: two maps differ in no more bits than their sets in shingles."""
    odd = np.bincount((shingles % np.uint64(64 * MAP_LONGS)).astype(np.int64), minlength=64 * MAP_LONGS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _shingled(docs: DataFrame, words: int) -> DataFrame:
    """(first, component_id, shingles, map) of `docs` (first, component_id, text)."""
    from pyspark.sql import types as T

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sets = [shingle_set(t, words) for t in texts_of(batch)]
            lists = [pa.array([f(x).view(np.int64).tolist() for x in sets], pa.list_(pa.int64())) for f in (np.asarray, parity_map)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["first", "component_id", "shingles", "map"])

    docs = docs.select("first", "component_id", "text")
    kinds = [(f.name, f.dataType) for f in docs.schema.fields[:2]]
    return docs.mapInArrow(run, schema(*kinds, ("shingles", T.ArrayType(T.LongType())), ("map", T.ArrayType(T.LongType()))))


def _rare_pairs(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b), a > b: pairs of `docs` (first, component_id, text) of different components that may reach the similarity.

    Two sets of that similarity share one of the |x| - ceil(similarity |x|) + 1 shingles of either that come first in any
    order common to all; here the rarest come first, so what many texts have in common is seldom a key. Under each key
    only texts outside its largest component look for partners, and a pair is a row only if the parity maps of its sets
    do not show that they differ in more shingles than the similarity allows.
    """
    sets = staged(_shingled(docs, words), "shingles")
    single = sets.select(F.explode("shingles").alias("shingle"), "first")
    often = single.groupBy("shingle").agg(F.count("*").alias("n"))
    ranked = single.join(often, "shingle").groupBy("first").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("order"))
    size = F.size("order")
    rare = F.slice("order", F.lit(1), (size - F.ceil(F.lit(similarity) * size - F.lit(1e-9)) + 1).cast("int"))
    keys = ranked.select("first", size.alias("size"), F.explode(F.filter(rare, lambda x: x["n"] > 1)).alias("key"))
    keys = staged(keys.join(sets.select("first", "component_id", "map"), "first").select("first", "size", "component_id", "map", "key.shingle"), "rare-shingles")
    largest = keys.groupBy("shingle", "component_id").agg(F.count("*").alias("n")).groupBy("shingle").agg(F.max_by("component_id", F.struct("n", "component_id")).alias("largest"))
    looking = keys.join(largest, "shingle").where("component_id <> largest")
    one, two = (side.select("shingle", *[F.col(c).alias(f"{c}_{end}") for c in ("first", "size", "component_id", "map")]) for side, end in ((looking, "a"), (keys, "b")))
    differ = sum((F.bit_count(F.get(F.col("map_a"), F.lit(i)).bitwiseXOR(F.get(F.col("map_b"), F.lit(i)))) for i in range(MAP_LONGS)), F.lit(0))
    # sets of similarity s differ in at most (1 - s) / (1 + s) of the sum of their sizes
    possible = (F.least("size_a", "size_b") >= F.lit(similarity) * F.greatest("size_a", "size_b")) & (
        differ <= F.lit((1 - similarity) / (1 + similarity)) * (F.col("size_a") + F.col("size_b")) + 1e-6)
    found = one.join(two, (one["shingle"] == two["shingle"]) & (F.col("component_id_a") != F.col("component_id_b")) & possible)
    return found.select(F.greatest("first_a", "first_b").alias("a"), F.least("first_a", "first_b").alias("b")).distinct()


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, max_bits: int = 3) -> DataFrame:
    """(doc_id, component_id) of texts linked by shingle sets of at least the given similarity.

    Fingerprints of whole texts differ in 10 of 64 bits on average at a similarity of 0.8, where no search within a few
    bits finds them. Candidates are therefore texts whose fingerprints are within max_bits, and texts with the same
    fingerprint of one of VIEWS min-wise samples of their shingles. Each is compared in full with the least doc_id of its
    group. The members of groups that this has not made one component go through an exact join on rare shingles, see
    _rare_pairs, which compares every two of different components that can reach the similarity: the pairs of a group are not listed. So only pairs that are in no group together
    are missed. Texts with the same words are one text. Rows without doc_id are left out, repeated doc_ids are one
    document. No rows give no rows.
    """
    rows = docs.where("doc_id is not null").select("doc_id", "text")
    sketches = staged(_sketches(rows, words), "sketches")
    classes = staged(sketches.groupBy("same").agg(F.min("doc_id").alias("first"), F.min(F.struct("bits", "size", "views")).alias("s")).select("same", "first", "s.*"), "texts")
    links = near_links(classes.select("bits").distinct(), max_bits)
    roots = component_ids(classes.select(F.col("bits").alias("key"), F.col("bits").alias("first")).distinct(), links)
    near = classes.join(roots.select(F.col("key").alias("bits"), F.col("component_id").alias("group")), "bits")
    views = classes.select(F.posexplode("views").alias("view", "group"), "first", "size")
    groups = near.select(F.lit(-1).alias("view"), "group", "first", "size").distinct().union(views.distinct())
    leaders = groups.groupBy("view", "group").agg(F.min("first").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = staged(groups.join(leaders, ["view", "group"]), "groups")
    alike = staged(_alike(staged(members.select(F.col("first").alias("a"), "b").where("a <> b").distinct(), "candidates"), rows, words, similarity), "copies")
    nodes = staged(classes.select(F.col("first").alias("key"), F.col("first").alias("first")).distinct(), "nodes")
    ids = staged(component_ids(nodes, alike), "led")
    known = members.drop("b").join(ids.withColumnRenamed("key", "first"), "first")
    split = known.groupBy("view", "group").agg(F.min("component_id").alias("x"), F.max("component_id").alias("y")).where("x <> y")
    open_ = known.join(split.select("view", "group"), ["view", "group"], "left_semi")
    open_ = staged(open_.select("first", "component_id").distinct(), "open")
    texts = open_.join(rows.groupBy("doc_id").agg(F.min("text").alias("text")), open_["first"] == F.col("doc_id")).select("first", "component_id", "text")
    pairs = staged(_rare_pairs(texts, words, similarity), "pairs")
    ids = component_ids(nodes, alike.union(_alike(pairs, rows, words, similarity)))
    least = classes.select("same", F.col("first").alias("key")).join(ids, "key").select("same", "component_id")
    return sketches.join(least, "same").select("doc_id", "component_id")


@with_plain_names
def without_near_copies(docs: DataFrame, **settings) -> DataFrame:
    """The rows of `docs` that have the least doc_id of their component, one per doc_id; rows without doc_id stay."""
    kept = staged(near_copies(docs, **settings).where("doc_id = component_id").select("doc_id").distinct(), "kept")
    one = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return one.select(*docs.columns).union(docs.where("doc_id is null"))
