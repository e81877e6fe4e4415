"""Generation settings, token lists and batch generation with stand-in models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import generate, render
from ..session import shared_path
from .registry import SQL_GENERATION, query, sql_segment, sql_strip, table


@query("""
    SELECT c_custkey, CAST(coalesce(CASE WHEN c_custkey % 3 = 0 THEN 64 END, 512) AS INTEGER) AS max_new_tokens,
      coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal / 16384 END, 0.7::DOUBLE) AS temperature, 0.9::DOUBLE AS top_p,
      CAST(coalesce(CASE WHEN c_nationkey < 5 THEN c_nationkey END, 50) AS INTEGER) AS top_k,
      coalesce(CASE WHEN c_custkey % 7 = 0 THEN false END, true) AS do_sample, 1.1::DOUBLE AS repetition_penalty
    FROM customer
""")
def gen_settings(spark, sf):
    """Settings of every request: its own values over the defaults."""
    requests = table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 3 == 0, 64).alias("max_new_tokens"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal") / 16384).alias("temperature"),
        F.when(F.col("c_nationkey") < 5, F.col("c_nationkey")).alias("top_k"),
        F.when(F.col("c_custkey") % 7 == 0, F.lit(False)).alias("do_sample"),
    )
    return generate.resolve_settings(requests)


@query("""
    SELECT p_partkey, coalesce(nullif(CAST(p_size % 3 AS DOUBLE), 0), nullif(CAST(p_partkey % 2 AS DOUBLE), 0), 512.0::DOUBLE) AS max_tokens,
      CAST(CASE WHEN p_size % 4 <> 0 THEN p_size % 4 ELSE p_partkey END AS BIGINT) AS pad_id
    FROM part
""")
def falsy_defaults(spark, sf):
    """Zero counts as unset, both for settings and for the padding id."""
    size = F.col("p_size")
    first, second = (size % 3).cast("double"), (F.col("p_partkey") % 2).cast("double")
    return table(spark, sf, "part").select(
        "p_partkey",
        generate.falsy_default(first, second, default=512.0).alias("max_tokens"),
        generate.pad_token((size % 4).cast("bigint"), F.col("p_partkey")).alias("pad_id"),
    )


@query("""
    SELECT p_partkey, array_to_string(stops, ',') AS stop_ids FROM (
      SELECT p_partkey, list_filter(ids, lambda x, i: x IS NOT NULL AND list_position(ids, x) = i) AS stops
      FROM (SELECT p_partkey, ids FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN [p_size, 2] WHEN 1 THEN [NULL, NULL]
            ELSE [p_size % 3, p_size % 5] END || [CASE WHEN p_partkey % 4 <> 3 THEN 2 END, p_size % 7] AS ids FROM part)))
""")
def stop_tokens(spark, sf):
    """Distinct stop ids in order of their sources."""
    k, size = F.col("p_partkey") % 4, F.col("p_size")
    config = F.when(k == 0, F.array(size, F.lit(2))).when(k > 1, F.array(size % 3, size % 5))
    stops = generate.stop_tokens(config, F.when(k != 3, F.lit(2)), size % 7)
    stops = generate.stop_tokens_or_eos(stops, F.lit(2))
    return table(spark, sf, "part").select("p_partkey", F.array_join(stops.cast("array<string>"), ",").alias("stop_ids"))


@query("""
    SELECT doc_id, array_to_string(list_transform(string_split(text, ' '), lambda w: length(w)), ' ') AS new_ids FROM documents
""")
def new_tokens(spark, sf):
    """Ids after the prompt, the output being the prompt's ids and one id per word."""
    documents = table(spark, sf, "documents")
    words = F.transform(F.split("text", " "), lambda w: F.length(w))
    prompt = F.array(F.length("lang"), F.length("source"))
    found = generate.new_tokens(F.concat(prompt, words), prompt)
    return documents.select("doc_id", F.array_join(found.cast("array<string>"), " ").alias("new_ids"))


_TOKENS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')"


@query(f"SELECT doc_id, array_to_string({_TOKENS}[1:64], ' ') AS tokens, least(len({_TOKENS}), 64) AS n FROM documents")
def truncate_tokens(spark, sf):
    """Token lists cut at the maximum sequence length."""
    documents = table(spark, sf, "documents")
    tokens = generate.truncate_tokens(generate.whitespace_tokens(F.col("text")), 64)
    return documents.select(
        "doc_id", F.array_join(tokens, " ").alias("tokens"), F.size(tokens).cast("bigint").alias("n")
    )


def _word_lengths():
    return lambda text: [len(word) for word in text.split(" ")]


@query("""
    SELECT doc_id, len(string_split(text, ' ')) AS n, CAST(list_sum(list_transform(string_split(text, ' '), lambda w: length(w))) AS BIGINT) AS total
    FROM documents
""")
def tokenizer_hook(spark, sf):
    """Token ids by a user tokenizer."""
    documents = table(spark, sf, "documents")
    ids = documents.select("doc_id", generate.tokenize_with(_word_lengths, F.col("text")).alias("ids"))
    total = F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return ids.select("doc_id", F.size("ids").cast("bigint").alias("n"), total.alias("total"))


def _echo():
    return lambda prompts, **settings: [(f" {p[::-1]} ", len(p)) for p in prompts]


@query(f"""
    SELECT doc_id, {sql_strip(f"reverse({sql_segment(chr(39) + 'user' + chr(39), 'text')} || {SQL_GENERATION})")} AS reply,
      length({sql_segment(chr(39) + 'user' + chr(39), 'text')} || {SQL_GENERATION}) AS new_tokens
    FROM documents
""")
def generate_stub(spark, sf):
    """Batch generation with a model that gives its prompt back in reverse."""
    documents = table(spark, sf, "documents")
    prompts = documents.select("doc_id", render.single_prompt(F.col("text")).alias("prompt"))
    return generate.generate_batch(prompts, _echo).select("doc_id", "reply", "new_tokens")


def _marked(mark):
    return lambda: lambda prompts: [f"{mark}{p[::-1]}x" for p in prompts]


@query("""
    SELECT doc_id, CASE WHEN bool_or(doc_id % 3 <> 0) OVER (PARTITION BY text) THEN 'first:' ELSE 'second:' END || reverse(text) || 'x' AS reply
    FROM documents
""")
def generate_resumed(spark, sf):
    """Batch generation in two runs that share a ledger: the second model is asked only for what the first has not answered."""
    prompts = table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))
    ledger = shared_path(spark, "replies")
    generate.generate_missing(prompts.where("doc_id % 3 <> 0"), _marked("first:"), ledger)
    return generate.generate_missing(prompts, _marked("second:"), ledger, commit_rows=500_000).select("doc_id", "reply")


def _by_settings():
    return lambda prompts, max_new_tokens: [(p[::-1], min(n, len(p))) for p, n in zip(prompts, max_new_tokens)]


@query("""
    SELECT doc_id, least(length(text), CASE WHEN doc_id % 2 = 0 THEN 100 ELSE 512 END) AS new_tokens FROM documents
""")
def generate_with_settings(spark, sf):
    """Batch generation with a setting that differs from row to row."""
    documents = table(spark, sf, "documents")
    requests = documents.select(
        "doc_id", F.col("text").alias("prompt"), F.when(F.col("doc_id") % 2 == 0, 100).alias("max_new_tokens")
    )
    requests = generate.resolve_settings(requests, {"max_new_tokens": 512})
    found = generate.generate_batch(requests, _by_settings, settings=("max_new_tokens",))
    return found.select("doc_id", "new_tokens")


@query("""
    SELECT l_returnflag, count(*) AS requests, CAST(sum(l_quantity) AS BIGINT) AS new_tokens, CAST(sum(l_linenumber) AS BIGINT) AS elapsed,
      sum(l_quantity) / sum(l_linenumber) AS tokens_per_second
    FROM lineitem GROUP BY l_returnflag
""")
def generation_throughput(spark, sf):
    """Tokens per second over groups of requests."""
    requests = table(spark, sf, "lineitem").select(
        "l_returnflag", F.col("l_quantity").cast("bigint").alias("new_tokens"), F.col("l_linenumber").alias("elapsed")
    )
    return generate.throughput(requests, "l_returnflag")


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax > 0 THEN l_quantity / l_tax ELSE 0 END AS tokens_per_second FROM lineitem
""")
def request_throughput(spark, sf):
    """Tokens per second of every request, 0 where no time passed."""
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        generate.tokens_per_second(F.col("l_quantity"), F.col("l_tax")).alias("tokens_per_second"),
    )
