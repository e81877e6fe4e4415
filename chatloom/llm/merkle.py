"""Merkle manifest of a document table, proved leaf by leaf with a recursive query.

Every row is a leaf: the SHA-256 of its length-prefixed fields. Leaves of a language in the order of doc_id form a
tree of runs of eight, and the languages' subroots form one more tree above them. Each level is one grouped
aggregate and is stored as rows of runs that name their parent: (tree, level, place) -> (next_tree, next_level,
next_place) and the spot they take in it. A recursive query then climbs from the leaves to the root; at each step it
folds the digest it has reached into the run that is stored there and appends that run's other digests to the proof.

The eight leaves of a run share every sibling above it, so they climb in one row with one folded digest each; a
row grows by 224 bytes a level. Runs high up are met by very many climbers: they are stored in as many salted
copies as make about CLIMBERS of them meet at each, so that no join key of the climb is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc32_sql, staged

SHIFT, CLIMBERS = 3, 4096
ARITY = 1 << SHIFT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Name of the tree of subroots; a language's tree is named "n" (null) or "s" and the language, which sorts alike.
TOP = ""
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def _hash(binary):
    """H of the hexadecimal text of digests that stand side by side in a binary value."""
    return F.unhex(F.sha2(F.lower(F.hex(binary)).cast("binary"), 256))


def _field(value):
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(values: dict):
    """The leaf digest of FIELDS, given as columns by name."""
    return F.unhex(F.sha2(F.concat(*[_field(values[name]) for name in FIELDS]).cast("binary"), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, leaf, shown): `shown` is the leaf as a reader finds it, lower-cased where 3 divides crc32(doc_id)."""
    own = {name: F.col(name) for name in FIELDS}
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    # a text without capitals stays as it is, and so does its leaf
    changed = hit & F.col("text").rlike("[A-Z]")
    shown = F.when(changed, leaf_hash({**own, "text": F.translate("text", letters, letters.lower())}))
    tree = F.when(F.col("lang").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("lang")))
    return docs.select(tree.alias("tree"), "doc_id", leaf_hash(own).alias("leaf"), shown.alias("changed")).select(
        "tree", "doc_id", "leaf", F.coalesce("changed", "leaf").alias("shown"))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` with `place` (0, 1, ... inside each `tree`, by `order`) and `width` (rows of the tree).

    Rows are ranged by tree and order and written; a row's place is its number in its file plus what earlier files
    hold of its tree. The table of those sums has a row per file and tree; Spark broadcasts it only if it finds the
    written bytes few. Order ties keep the order in which they were written.
    """
    rows = staged(rows, "merkle-rows")  # ranging reads its input twice: digests are not made twice
    number = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("row", F.monotonically_increasing_id())
    number = staged(number, "merkle-order").withColumn("part", F.shiftright("row", 33))
    sums = number.groupBy("tree", "part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    tree = W.partitionBy("tree")
    earlier = F.coalesce(F.sum("n").over(tree.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = staged(sums.select("tree", "part", (earlier - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("width")), "merkle-sums")
    return number.join(sums, ["tree", "part"]).withColumn("place", F.col("row") + F.col("shift")).drop("part", "row", "shift")


def _runs(nodes: DataFrame, level: int) -> DataFrame:
    """(tree, level, place, width, children, digest) of the runs over `nodes` (tree, place, width, digest)."""
    ordered = F.sort_array(F.collect_list(F.struct("place", "digest")))  # eight at most
    grouped = nodes.where("width > 1").groupBy("tree", F.shiftright("place", SHIFT).alias("run"))
    grouped = grouped.agg(ordered.alias("nodes"), F.first("width").alias("width"))
    children = F.aggregate("nodes", F.lit(b""), lambda done, node: F.concat(done, node["digest"])).alias("children")
    run = grouped.select("tree", F.lit(level).alias("level"), F.col("run").alias("place"), F.shiftright(F.col("width") + (ARITY - 1), SHIFT).alias("width"), children)
    return run.withColumn("digest", _hash(F.col("children")))


def levels(nodes: DataFrame) -> list[DataFrame]:
    """The stored levels of runs over `nodes` (tree, place, width, digest), until every tree has one node."""
    widest = nodes.agg(F.max("width")).first()[0] or 0
    built = [staged(_runs(nodes, 1), "merkle-level")]
    while (widest := -(-widest // ARITY)) > 1:
        built.append(staged(_runs(built[-1], len(built) + 1), "merkle-level"))
    return built


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def _linked(nodes: DataFrame, ranks: DataFrame, top_copies: int, climbers: int) -> DataFrame:
    """`nodes` (tree, level, place, width, ..) with the run above them: next_tree, next_level, next_place, spot, copies.

    `ranks` (tree, rank, trees) places each tree's last node in the tree of subroots; the root has nothing above it.
    """
    nodes = nodes.join(ranks, "tree", "left")
    inside, climbs = F.col("width") > 1, (F.col("tree") != TOP) & (F.col("trees") > 1)
    up = F.when(inside, F.col("place")).when(climbs, F.col("rank"))
    next_tree = F.when(inside, F.col("tree")).when(climbs, F.lit(TOP))
    next_level = F.when(inside, F.col("level") + 1).when(climbs, F.lit(1))
    own = [c for c in nodes.columns if c not in ("rank", "trees")]
    return nodes.select(
        *own, next_tree.alias("next_tree"), next_level.alias("next_level"), F.shiftright(up, SHIFT).alias("next_place"),
        (up % ARITY).cast("int").alias("spot"), _copies(next_tree, next_level, top_copies, climbers).alias("copies"))


def _copies(tree, level, top_copies: int, climbers: int):
    """In how many copies a run is stored: a run of level n is met by 8^(n - 1) rows at most."""
    met = F.pow(F.lit(float(ARITY)), (level - 1).cast("double"))
    return F.when(tree == TOP, F.lit(top_copies)).when(tree.isNotNull(), F.greatest(F.lit(1.0), F.ceil(met / climbers)).cast("long"))


# a step folds every leaf of a row into the run that the row points at; before the first one each leaf has its own spot
_CLIMB = """
WITH RECURSIVE climb AS (
  SELECT ids, own, mark, folded, path, subroot, root, next_tree, next_level, next_place, spot, copy FROM {bundles}
  UNION ALL
  SELECT c.ids, c.own, c.mark,
    transform(c.folded, (x, i) -> unhex(sha2(lower(hex(overlay(r.children PLACING x FROM 32 * coalesce(c.spot, i) + 1 FOR 32))), 256))),
    CASE WHEN c.spot IS NULL THEN c.path ELSE concat(c.path, substring(r.children, 1, 32 * c.spot), substring(r.children, 32 * c.spot + 33)) END,
    CASE WHEN r.tree <> '' AND r.width = 1 THEN r.digest ELSE c.subroot END,
    r.digest, r.next_tree, r.next_level, r.next_place, r.spot, pmod(c.mark, r.copies)
  FROM climb c JOIN {runs} r ON c.next_tree = r.tree AND c.next_level = r.level AND c.next_place = r.place AND c.copy = r.copy)
SELECT ids, own, folded, path, subroot, root FROM climb WHERE next_tree IS NULL"""


def _climbed(bundles: DataFrame, runs: DataFrame) -> DataFrame:
    """The rows of `bundles` at the root. The number of rows that a recursion may give is a setting: none while it runs."""
    spark = bundles.sparkSession
    before = spark.conf.get(_ROW_LIMIT)
    spark.conf.set(_ROW_LIMIT, "-1")
    try:
        return staged(spark.sql(_CLIMB, bundles=bundles, runs=runs), "merkle-climb")
    finally:
        spark.conf.set(_ROW_LIMIT, before)


def manifest(docs: DataFrame, climbers: int = CLIMBERS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per input row.

    Leaves with a null doc_id come first; rows of equal lang and doc_id are ordered by their leaf digests, so repeated
    rows are as many leaves. A null lang is a language, before all others. Null fields are hashed as `-`, empty texts as
    `0:`. A leaf alone in its language is its subroot; a document alone in the table is the root and its proof is
    the digest of nothing. Extra columns are ignored, no rows give no rows.
    """
    # ids and digests only: texts are not shuffled
    leaf = staged(ranked(leaves(docs.select(*FIELDS)), "doc_id", "leaf").withColumn("level", F.lit(0)), "merkle-leaves")
    low = levels(leaf.withColumn("digest", F.col("leaf")))
    tops = _union([leaf.select("tree", "width", F.col("leaf").alias("digest"))] + [x.select("tree", "width", "digest") for x in low]).where("width = 1")
    subroot = ranked(tops.select(F.lit(TOP).alias("tree"), F.col("tree").alias("of"), "digest"), "of")
    subroot = staged(subroot, "merkle-subroots")
    high = levels(subroot)
    ranks = subroot.select(F.col("of").alias("tree"), F.col("place").alias("rank"), F.col("width").alias("trees"))

    item = F.struct("place", "doc_id", "leaf", "shown")
    bundle = leaf.groupBy("tree", F.shiftright("place", SHIFT).alias("run")).agg(F.sort_array(F.collect_list(item)).alias("items"), F.first("width").alias("width"))
    concat = F.aggregate("items", F.lit(b""), lambda done, x: F.concat(done, x["leaf"]))
    bundle = bundle.select(
        "tree", F.col("run").alias("place"), "width", F.lit(0).alias("level"), F.transform("items", lambda x: x["doc_id"]).alias("ids"), concat.alias("own"),
        F.transform("items", lambda x: x["shown"]).alias("folded"), F.xxhash64("tree", "run").alias("mark"), F.lit(b"").alias("path"))
    total = leaf.count()
    # copies of the top runs times their number stay below the number of climbing rows
    top_copies = max(1, min(-(-total // (ARITY * climbers)), total // ARITY // max(1, ranks.count())))
    bundle = _linked(bundle, ranks, top_copies, climbers)
    alone = F.col("width") == 1
    # a run of leaves points at itself with a spot for each; a leaf alone in its language starts at the tree above
    bundle = bundle.withColumn("spot", F.when(alone, F.col("spot"))).withColumn("next_place", F.when(alone, F.col("next_place")).otherwise(F.col("place")))
    bundle = bundle.withColumn("copy", F.when(alone, F.pmod("mark", "copies")).otherwise(F.lit(0).cast("long")))
    single = F.when(alone, F.col("own"))
    bundles = staged(bundle.withColumn("subroot", single).withColumn("root", single).drop("copies"), "merkle-bundles")

    runs = _linked(_union(low + high), ranks, top_copies, climbers)
    own_copies = _copies(F.col("tree"), F.col("level"), top_copies, climbers)
    runs = staged(runs.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), own_copies.cast("long") - 1))), "merkle-runs")

    found = _climbed(bundles, runs).select(F.posexplode(F.arrays_zip("ids", "folded")).alias("i", "one"), "own", "path", "subroot", "root")
    cut = F.col("i") * 32
    own, size = F.col("own"), F.octet_length("own")
    others = F.concat(F.substring(own, F.lit(1), cut), F.substring(own, cut + 33, size))
    text = lambda binary: F.lower(F.hex(binary))
    return found.select(
        F.col("one.ids").alias("doc_id"), text(F.substring(own, cut + 1, F.lit(32))).alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
        F.sha2(text(F.concat(others, "path")).cast("binary"), 256).alias("proof_sha256"), text("one.folded").alias("folded_root"),
        (F.col("one.folded") == F.col("root")).alias("verified"))


def _field_sql(name: str, value: str | None = None) -> str:
    text = f"CAST({value or name} AS VARCHAR)"
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen({text}) || ':' || {text} END"


def sql(depth: int = 8) -> str:
    """The same rows in DuckDB's SQL for up to 8^depth leaves a language."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    leaf = " || ".join(_field_sql(n) for n in FIELDS)
    shown = " || ".join(_field_sql(n, f"translate(text, '{letters}', '{letters.lower()}')" if n == "text" else None) for n in FIELDS)
    steps = [f"""
d AS (SELECT row_number() OVER () AS id, doc_id, coalesce('s' || lang, 'n') AS tree, sha256({leaf}) AS leaf,
  CASE WHEN ({crc32_sql("CAST(doc_id AS VARCHAR)")}) % 3 = 0 THEN sha256({shown}) ELSE sha256({leaf}) END AS shown FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS width FROM d),
c0 AS (SELECT id, doc_id, tree, leaf, shown AS folded, '' AS proof, place, width, leaf AS digest FROM p)"""]

    def level(before: str, after: str, tree: str, rest: str):
        # per node of a level its run's text; leaves below share it
        steps.append(f"""
n_{after} AS (SELECT DISTINCT {tree} AS tree, place, width, digest FROM {before}),
g_{after} AS (SELECT tree, place // 8 AS run, string_agg(digest, '' ORDER BY place) AS t, max(width) AS width FROM n_{after} GROUP BY tree, place // 8),
{after} AS (SELECT id, doc_id, c.tree, leaf{rest},
  CASE WHEN g.width > 1 THEN sha256(t[1:64 * (place % 8)] || folded || t[64 * (place % 8) + 65:]) ELSE folded END AS folded,
  CASE WHEN g.width > 1 THEN proof || t[1:64 * (place % 8)] || t[64 * (place % 8) + 65:] ELSE proof END AS proof,
  place // 8 AS place, CAST(ceil(c.width / 8.0) AS BIGINT) AS width, CASE WHEN g.width > 1 THEN sha256(t) ELSE digest END AS digest
  FROM {before} c JOIN g_{after} g ON g.tree = {tree.replace("tree", "c.tree")} AND g.run = c.place // 8)""")

    for i in range(depth):
        level(f"c{i}", f"c{i + 1}", "tree", "")
    steps.append(f"""
r AS (SELECT tree, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS width FROM (SELECT DISTINCT tree FROM d)),
t0 AS (SELECT c.id, doc_id, c.tree, leaf, digest AS subroot, folded, proof, r.place, r.width, digest FROM c{depth} c JOIN r ON c.tree = r.tree)""")
    for i in range(3):
        level(f"t{i}", f"t{i + 1}", "''", ", subroot")
    return f"""WITH {",".join(steps)}
SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = digest AS verified FROM t3"""
