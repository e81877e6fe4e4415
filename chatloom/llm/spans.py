"""Matches of regular expressions with their places, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found>> of the leftmost non-overlapping matches; code points, end exclusive.

    A place is the sum of the lengths of all gaps and matches before it. Texts without a match are searched
    once and give an empty array.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    steps = F.zip_with(gaps, found, lambda gap, match: F.struct(F.length(gap).alias("gap"), F.length(match).alias("long")))
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")

    def add(state: Column, step: Column) -> Column:
        # places are gathered as text: appending to a string costs far less than to an array
        start = state["at"] + step["gap"]
        end = start + step["long"]
        out = F.concat(state["out"], start.cast("string"), F.lit(":"), end.cast("string"), F.lit(","))
        return F.when(step["long"].isNull(), state).otherwise(F.struct(end.alias("at"), out.alias("out")))

    walked = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, lambda state: state["out"])
    places = F.split(walked, ",", -1)

    def whole(at: Column, match: Column) -> Column:
        ends = F.split(at, ":", -1)
        return F.struct(ends[0].cast("int").alias("start"), ends[1].cast("int").alias("end"), match.alias("found"))

    zipped = F.zip_with(F.slice(places, 1, F.size(places) - 1), found, whole)
    return F.when(text.rlike(pattern), zipped).otherwise(none)


def place(kinds: list[str], kind: Column) -> Column:
    """The place of a kind in the list."""
    return F.array_position(F.array(*[F.lit(k) for k in kinds]), kind).cast("int")


def listed(found: Column, *order) -> Column:
    """kind:start:end of the spans, comma-joined, in the order of the given functions of a span."""
    keyed = F.transform(found, lambda x: F.struct(*[f(x).alias(f"k{i}") for i, f in enumerate(order)], x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def how_many(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)
