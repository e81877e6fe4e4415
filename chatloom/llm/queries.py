"""The registered queries of this subpackage, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, embedding, factors, merkle, mixing, packing, pii, quality, secrets, simhash, spelling, substring, toxicity
from .common import table


def op1_embeddings(spark, sf_dir):
    return embedding.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_mixing(spark, sf_dir):
    return mixing.mix(mixing.sizes_of(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken", "source")


def op3_packing(spark, sf_dir):
    import public_tokenizers

    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_secrets(spark, sf_dir):
    return secrets.summary(secrets.scan_documents(table(spark, sf_dir, "documents")))


def op5_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def op6_pii(spark, sf_dir):
    return pii.summary(pii.find(table(spark, sf_dir, "documents")))


def op7_quality(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_chat(spark, sf_dir):
    hard = "<|im_end|><|im_start|>assistant ok"
    # a fixed conversation whose texts look like markers, beside all others
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.chunks(rows))


def op9_substrings(spark, sf_dir):
    return substring.deduplicated(table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_manifest(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_spelling(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_classifier(spark, sf_dir):
    return factors.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    op1_embeddings, op2_mixing, op3_packing, op4_secrets, op5_simhash, op6_pii, op7_quality, op8_chat, op9_substrings, op10_toxicity,
    op11_manifest, op12_spelling, op13_classifier)}

_OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.r),
least AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links, least.component_id,
  coalesce(e.vec_id = least.component_id, false) AS kept
FROM embeddings e LEFT JOIN least ON e.vec_id = least.vec_id"""


def _spans_sql(kind: str, number: int, pattern: str, keep: str = "true") -> str:
    """Rows (doc_id, kind, k, s, e) of one kind; a place is the length of all gaps and matches before it."""
    pattern = pattern.replace("'", "''")
    return f"""
  SELECT doc_id, '{kind}' AS kind, {number} AS k, s, s + length(m[i]) AS e FROM (
    SELECT doc_id, m, i, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s FROM (
      SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM d WHERE regexp_matches(t, '{pattern}'))))
  WHERE {keep}"""


def _op4() -> str:
    assign = secrets.ASSIGN.replace("'", "''")
    parts = [_spans_sql("assign", 0, secrets.ASSIGN, f"length(regexp_extract(m[i], '{assign}', 2)) >= 12"),
             _spans_sql("access", 1, "AKIA[A-Z0-9]+", "length(m[i]) >= 18"), _spans_sql("hex", 2, "[0-9a-f]+", "length(m[i]) >= 16")]
    parts += [_spans_sql(rule.kind, i, rule.pattern) for i, rule in enumerate(secrets.ADDED, 3)]
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({' UNION ALL '.join(parts)}),
p AS (SELECT doc_id, sum(CAST(k = 0 AS BIGINT)) AS a, sum(CAST(k = 1 AS BIGINT)) AS c, sum(CAST(k = 2 AS BIGINT)) AS h,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS w
  FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(c, 0) AS BIGINT) AS n_access, CAST(coalesce(h, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(w, '') AS spans
FROM d LEFT JOIN p ON d.doc_id = p.doc_id"""


_OP8 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, x, CASE x WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) t(x)),
e AS (SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS et, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS er FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(er) + length(et) + 24) AS BIGINT) AS formatted_chars, CAST(sum(CAST(role = 'assistant' AS BIGINT)) AS BIGINT) AS n_examples
FROM e GROUP BY conv_id"""

_OP9 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT x, min(doc_id) AS first FROM s GROUP BY x),
hit AS (SELECT s.doc_id, s.i FROM s JOIN m USING (x) WHERE m.first < s.doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM hit, range(13) t(j)),
lost AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN lost ON d.doc_id = lost.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id"""

ORACLES = {"op1_embeddings": _OP1, "op4_secrets": _op4(), "op8_chat": _OP8, "op9_substrings": _OP9, "op11_manifest": merkle.sql(), "op12_spelling": spelling.sql()}
