"""Certified rules against plain Python, rounding of mixes, and stages with clashing column names."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chatloom.llm import mixing, quality, secrets, simhash

SF = "/root/testdata/sf0.01"
KINDS = ("symbols", "repeats", "dup_lines", "capitals", "marks", "long_words")


def _signals(text):
    words, chars, symbols, dup, repeats, lines, capitals, marks = quality.counts_of((text or "").encode())
    share = lambda part, whole: min(1.0, part / max(whole, 1))
    values = (share(symbols, words), share(repeats, words), share(dup, lines), share(capitals, chars), share(marks, words), share(chars, words * 40))
    return [min(49, math.floor(v * 50)) for v in values], words < 20 or 100 * repeats > 30 * words


def _tail(k, n, p):
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def _plain_rules(docs, labels, tuning, risk, delta):
    """The rule of each language, by the method's description."""
    taught = {}
    for doc_id, (lang, text) in docs.items():
        cells, failed = _signals(text)
        if not failed and doc_id in labels:
            taught.setdefault(lang, []).append((cells, labels[doc_id], tuning[doc_id]))
    rules = {}
    for lang, rows in taught.items():
        own, rest = [r for r in rows if r[2]], [r for r in rows if not r[2]]
        good = sum(q for _, q, _ in own)
        table = []
        for share in (0, 0.125, 0.25, 0.5, 1):
            for s in range(6):
                cut = next(c for c in range(51) if sum(q for x, q, _ in own if x[s] >= c) <= share * risk * good)
                cut = min(50, max(1, cut + (share == 0)))
                gain = sum(1 - q for x, q, _ in own if x[s] >= cut) - 20 * sum(q for x, q, _ in own if x[s] >= cut)
                table.append((share, s, cut if gain > 0 else 50, gain))
        order = sorted(range(6), key=lambda s: (-table[s][3], s))
        now, best, top = [50] * 6, [50] * 6, 0
        n = sum(q for _, q, _ in rest)
        for share in (0, 0.125, 0.25, 0.5, 1):
            row = {s: cut for sh, s, cut, _ in table if sh == share}
            for s in order:
                if row[s] >= now[s]:
                    continue
                now[s] = row[s]
                hit = [q for x, q, _ in rest if any(v >= c for v, c in zip(x, now, strict=True))]
                k, b = sum(hit), len(hit) - sum(hit)
                if not (n and k < n * risk and _tail(k, n, risk) <= delta / len(taught)):
                    break
                if b - 20 * k > top:
                    best, top = list(now), b - 20 * k
            else:
                continue
            break
        rules[lang] = best
    return rules


@pytest.mark.parametrize("risk", [0.02, 0.1, 0.3])
def test_kept_equals_plain_rules(spark, monkeypatch, risk):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    plain = {r.doc_id: (r.lang, r.text) for r in docs.collect()}
    tuning = {r.doc_id: r.t for r in docs.select("doc_id", (F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(4)) == 0).alias("t")).collect()}
    rules = _plain_rules(plain, {r.doc_id: r.quality for r in labels.collect()}, tuning, risk, 0.05)
    stats = quality.counted(docs.select("doc_id", "lang", "text")).drop("text")
    limits = quality.cutoffs(stats, labels, risk=risk)
    found = {r.stratum[1:]: [round(r[k] * 50) for k in KINDS] for r in limits.collect()}
    assert found == rules
    assert any(r != [50] * 6 for r in rules.values()) == (risk > 0.02)  # too few labels here for 2 %
    kept = {r.doc_id: r["__kept"] for r in quality._judged(stats, limits).collect()}
    for i, (lang, text) in plain.items():
        cells, failed = _signals(text)
        assert kept[i] == (not failed and not any(v >= c for v, c in zip(cells, rules[lang], strict=True)))


def test_ladder_is_nested_and_starts_with_the_most_useful():
    good, bad = np.zeros((6, 50), int), np.zeros((6, 50), int)
    good[:, 0], bad[:, 0] = 1000, 100
    good[0, 0], good[0, 10], bad[0, 0], bad[0, 20] = 995, 5, 40, 60
    bad[3, 0], bad[3, 30] = 20, 80
    rungs = quality.ladder(good, bad, 0.02)
    assert rungs[0][3] < 50 and rungs[0][0] == 50 and rungs[1][0] == 12
    for a, b in zip(rungs, rungs[1:], strict=False):
        assert all(x >= y for x, y in zip(a, b, strict=True)) and a != b


@pytest.mark.parametrize("seed", range(6))
def test_fit_favours_no_length(seed):
    chance = np.random.default_rng(seed)
    sizes = np.concatenate([chance.integers(1, 3000, 4000), chance.integers(40_000, 90_000, 5)])
    lengths, counts = np.unique(sizes, return_counts=True)
    total = int(sizes.sum())
    budget = int(total * chance.uniform(0.2, 0.8))
    picks = mixing.fit(lengths, counts, budget, total, seed)
    assert (picks >= 0).all() and (picks <= counts).all() and int((picks * lengths).sum()) == budget
    usual = lengths < 3000
    mean = lambda n: float((n * lengths)[usual].sum() / n[usual].sum())
    assert mean(picks) == pytest.approx(mean(counts), rel=0.08)
    assert (picks == mixing.fit(lengths, counts, budget, total, seed)).all()


@pytest.mark.parametrize("sizes, budget", [([7], 5), ([5, 5, 5], 10), ([9, 100_000], 50_000), ([0, 0, 3], 2), ([4, 6, 10], 20), ([1], 0)])
def test_fit_of_few_texts_is_the_best_sum_or_close(sizes, budget):
    lengths, counts = np.unique(np.array(sizes), return_counts=True)
    picks = mixing.fit(lengths, counts, budget, sum(sizes))
    sums = {0}
    for n in sizes:
        sums |= {s + n for s in sums}
    found = int((picks * lengths).sum())
    assert found in sums and found <= budget and budget - found <= max(sizes)


NAMES = ["__counts", "__kept", "__failed", "__stratum", "__limits", "__key", "__found", "__blob", "__findings", "findings", "__copy", "__copies", "__doc",
         "__source", "__size", "size", "a.b", "tick`s", "component_id", "extra_0", "quality", "stratum", "h", "blob", "TEXT_"]


@pytest.mark.parametrize("stage", ["quality", "dedup", "secrets", "mixing"])
def test_stages_keep_columns_of_any_name(spark, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    run = {"quality": lambda d: quality.good_documents(d, labels), "dedup": simhash.without_near_copies,
           "secrets": secrets.clean_documents, "mixing": mixing.mixed_documents}[stage]
    wide = docs.select("*", *[F.concat(F.lit(f"{i}:"), F.col("doc_id")).alias(n) for i, n in enumerate(NAMES)])
    found = run(wide)
    assert found.columns == docs.columns + NAMES
    rows, plain = found.collect(), run(docs).collect()
    assert sorted(tuple(r)[: len(docs.columns)] for r in rows) == sorted(map(tuple, plain)) and rows
    assert all(list(r)[len(docs.columns):] == [f"{i}:{r.doc_id}" for i in range(len(NAMES))] for r in rows)
    assert run(wide.limit(0)).count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality rules"
