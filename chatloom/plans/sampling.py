"""Seeded order, samples, numbers and training batches over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling
from .registry import query, table

_ORDER = "md5('42:' || doc_id), doc_id"


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {_ORDER}) - 1 AS number FROM documents")
def seeded_numbers(spark, sf):
    """Place of every document in the seeded order."""
    return sampling.seeded_numbers(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query(f"SELECT doc_id, n_chars, row_number() OVER (ORDER BY {_ORDER}) - 1 AS place FROM documents")
def seeded_shuffle(spark, sf):
    """The seeded permutation keeps every row; with the place each row has in it."""
    documents = table(spark, sf, "documents").select("doc_id", "n_chars")
    return sampling.row_places(sampling.seeded_shuffle(documents, "doc_id"), "place")


@query(f"SELECT doc_id, text FROM documents ORDER BY {_ORDER} LIMIT 100")
def seeded_sample(spark, sf):
    """First 100 documents of the seeded order."""
    return sampling.seeded_sample(table(spark, sf, "documents"), "doc_id", 100).select("doc_id", "text")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem l SEMI JOIN (SELECT o_orderkey FROM orders "
       "ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 12000) o ON l.l_orderkey = o.o_orderkey")
def seeded_sample_large(spark, sf):
    """Lines of 12000 sampled orders: a sample too large for a top-k is cut by bucket counts."""
    orders = sampling.seeded_sample(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 12_000, ordered=False)
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")


@query("""
    SELECT doc_id, idx, idx + 1 AS number, (SELECT count(*) FROM documents) AS total
    FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents)
""")
def prompt_index(spark, sf):
    """Number and total of every prompt, in the order of the prompts."""
    return sampling.with_progress(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS idx FROM documents")
def ordered_numbers(spark, sf):
    """Place of every document in the order of its source and id."""
    documents = table(spark, sf, "documents").select("source", "doc_id")
    return sampling.ordered_numbers(documents, "source", "doc_id", name="idx").select("doc_id", "idx")


_PLAN = """
    WITH n AS (SELECT count(*) AS total, CAST(ceil(count(*) / {batch}.0) AS BIGINT) AS steps FROM documents),
    e AS (SELECT unnest(generate_series(0, CAST(ceil({steps} / (SELECT steps FROM n)::DOUBLE) AS BIGINT) - 1)) AS epoch),
    r AS (SELECT epoch, doc_id, row_number() OVER (PARTITION BY epoch ORDER BY md5('3407:' || epoch || ':' || doc_id)) - 1 AS k
      FROM documents, e),
    s AS (SELECT epoch, doc_id, k, epoch * (SELECT steps FROM n) + k // {batch} AS step FROM r)
    SELECT epoch, step, k // {device} AS micro_batch, k % {device} AS slot,
      (step + 1) % {interval} = 0 AS logged, doc_id
    FROM s WHERE step < {steps}
"""


@query(_PLAN.format(batch=8, device=2, steps=2000, interval=100))
def batch_plan(spark, sf):
    """Training batches with the default settings."""
    return sampling.batch_plan(table(spark, sf, "documents"), "doc_id")


@query(_PLAN.format(batch=4, device=1, steps=2000, interval=100))
def batch_plan_cpu(spark, sf):
    """Training batches with the limits of a machine without an accelerator."""
    per_device, _ = sampling.cpu_limits(2, 1024)
    return sampling.batch_plan(table(spark, sf, "documents"), "doc_id", per_device=per_device)
