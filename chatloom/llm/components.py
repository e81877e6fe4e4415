"""Connected components of a link table, on Spark throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def stars(links: DataFrame) -> DataFrame:
    """(a, b): for every node a of `links` (a, b) that is not the least of its component, that least node b.

    Alternates the large-star and the small-star step until the links no longer change: the rounds
    grow with the logarithm of the longest chain. Every round is two joins on links alone, written to
    the shared folder. A node with very many neighbours is one hot join key, which adaptive execution
    splits; its least neighbour comes from a map-side combined aggregate. Links with a null end and
    links of a node to itself are ignored; no links give no rows.
    """
    links = links.where("a is not null and b is not null and a <> b")
    links = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        mark = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == before or mark[0] == 0:
            return links
        before = mark
        links = staged(_small_star(_large_star(links)), "links")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    joined = both.where("b > a").join(least.select("a", F.least("a", "m").alias("m")), "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    rest = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.union(least.select("a", F.col("m").alias("b"))).distinct()


def component_ids(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(key, component_id) for `classes` (key, first) joined by `links` of keys.

    `first` is the least id of a class of equal items; component_id is the least one in its component.
    """
    star = stars(links).select(F.col("a").alias("key"), F.col("b").alias("root"))
    member = classes.join(star, "key", "left").select("key", "first", F.coalesce("root", "key").alias("root"))
    least = member.groupBy("root").agg(F.min("first").alias("component_id"))
    return member.join(least, "root").select("key", "component_id")
