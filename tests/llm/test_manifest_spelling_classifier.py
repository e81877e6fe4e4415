"""Merkle manifest, spelling variants and the quality classifier: brute force, edge rows, held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from chatloom.llm import factors, merkle, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, place int, level int, word string, n int, key string, score double, quality int"
ODD = [
    (1, "", "en", "s", 0), (2, None, None, None, None), (None, "Some Words there", "en", "s", 16), (None, None, None, None, None), (3, "alone", "zz", "s", 5),
    (4, "A" * 50_000, "en", "s", -1), (4, "A" * 50_000, "en", "s", -1), (5, "Ärger Éclair × ÷ 漢字 \U0001f600", "fr", None, 99), (6, "x y z", "é", "s", 5),
    (7, "\t \n\x0b", "en", "s", 1), *[(i, f"Text {i}", "en", "s", 6) for i in range(100, 230)],
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 8) for r in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


# ---- Merkle manifest -------------------------------------------------------


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    fields = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return H(fields)


def lowered(text):
    return None if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)


def climb(nodes, shown, proofs, below):
    """Levels over `nodes`; every leaf in below[i] gets the siblings and folds of its path."""
    while len(nodes) > 1:
        runs = [range(at, min(at + 8, len(nodes))) for at in range(0, len(nodes), 8)]
        for run in runs:
            for i in run:
                for leaf in below[i]:
                    proofs[leaf] += [nodes[j] for j in run if j != i]
                    shown[leaf] = H([shown[leaf] if j == i else nodes[j] for j in run])
        nodes, below = [H([nodes[j] for j in run]) for run in runs], [[leaf for j in run for leaf in below[j]] for run in runs]
    return nodes[0]


def manifest_of(rows):
    by_lang, out = {}, []
    for r in rows:
        by_lang.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    shown, proofs, of, subroots, below = {}, {}, {}, [], []
    for lang in sorted(by_lang, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted(by_lang[lang], key=lambda x: x[:3])
        keys = [(lang, i) for i in range(len(own))]
        for key, (_, _, leaf, r) in zip(keys, own, strict=True):
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            shown[key], proofs[key], of[key] = leaf_of(r[0], lowered(r[1]), *r[2:]) if hit else leaf, [], (r[0], leaf)
        subroots.append(climb([o[2] for o in own], shown, proofs, [[k] for k in keys]))
        below.append(keys)
    tops = dict(zip([b[0][0] for b in below], subroots, strict=True))
    root = climb(subroots, shown, proofs, below)
    for key, (doc_id, leaf) in of.items():
        out.append((doc_id, leaf, tops[key[0]], root, H(proofs[key]), shown[key], shown[key] == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("climbers", [1, 3, 4096])
def test_manifest_against_plain_trees(spark, odd, climbers):
    assert sorted(map(tuple, merkle.manifest(odd, climbers).collect()), key=str) == manifest_of(ODD)


def test_manifest_of_many_languages(spark):
    """More than eight languages give a tree of subroots of two levels; some are single leaves."""
    rows = [(i, f"T{i}", f"l{i % 11 if i > 30 else i}", "s", i) for i in range(120)]
    assert sorted(map(tuple, merkle.manifest(frame(spark, rows), 2).collect()), key=str) == manifest_of(rows)


@pytest.mark.parametrize("count", [1, 2, 8, 9])
def test_small_manifests(spark, count):
    rows = [(i, "Ab", None, None, None) for i in range(count)]
    found = sorted(map(tuple, merkle.manifest(frame(spark, rows)).collect()), key=str)
    assert found == manifest_of(rows)
    assert merkle.manifest(frame(spark, rows).limit(0)).count() == 0


def test_recursion_setting_is_kept(spark, odd):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    merkle.manifest(odd).count()
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before


# ---- spelling variants -----------------------------------------------------


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_of(rows):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            mark = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if mark % 199 == 0:
                run = run[: mark % len(run)] + run[mark % len(run) + 1 :]
            if len(run) >= 6:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 5}
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    root = {}
    for w in n:
        root[w] = w
        while form[root[w]]:
            root[w] = form[root[w]]
    return sorted((w, form[w] or "", root[w], n[w], len(near[w]), n[form[w]] if form[w] else 0) for w in n)


def found_variants(docs, most=spelling.GROUP):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spelling.variants(docs, most).collect())


def family(seed, letters, base):
    """Words around a few others, chains of ever more frequent ones and doubled letters included."""
    rng, words = random.Random(seed), {}
    for word in base:
        for times in (5, 7, 30, 200):
            words[word] = max(words.get(word, 0), times)
            at = rng.randrange(len(word) + 1)
            word = rng.choice([word[:at] + rng.choice(letters) + word[at:], word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at + 1 :]])
    return words


@pytest.mark.parametrize("most", [2, 8192])
def test_variants_against_all_pairs(spark, most):
    words = family(1, "abcé", ["aaaaaaaa", "abcabcabc", "caballo", "éééééé", "bbbbbbbbbbbbbbbb", "ÿÀÿÀÿÀÿ"] + ["ab" * 4 + c for c in "abcdefgh"])
    rows = [(i % 7 if i % 5 else None, " ".join([w, w.upper()]) + ("." if i % 2 else "\n漢"), None, None, None) for w, c in words.items() for i in range(c // 2 + 1)]
    expected = variants_of(rows)
    assert len(expected) > 30 and any(form for _, form, *_ in expected) and any(root != (form or word) for word, form, root, *_ in expected)
    assert found_variants(frame(spark, rows), most) == expected


def test_variants_of_odd_rows(spark, odd):
    assert found_variants(odd) == variants_of(ODD)
    assert spelling.variants(odd.limit(0)).count() == 0


def test_letters_of_texts():
    text = "Über×Straße ÷ naïve漢字Word ŒUVRE \U0001f600end x-Y_z ¿ÀÿĀq"
    assert [r.decode() for r in spelling.runs_of(text.encode())] == [lowered(r) for r in re.findall("[A-Za-zÀ-ÿ]+", text)]


def test_groups_shrink_without_loss(spark):
    """All words share their halves with very many others; groups are dealt again until they are small, and no pair is lost."""
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.choice([9, 10]))) for _ in range(900)})
    table = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    sizes = spelling.groups(table, 20).groupBy("key").agg(F.count("*").alias("c"), F.max(F.col("hi") - F.col("lo")).alias("part")).collect()
    assert all(s.c <= 20 or s.part == 1 for s in sizes)
    found = {(r.word, r.near) for r in spelling.links(table, 20).collect()}
    assert found == {(a, b) for a in words for b in words if one_apart(a, b)}


@pytest.mark.parametrize("bounds", [(1, 1), (1 << 14, 64)])
def test_index_in_small_portions(monkeypatch, bounds):
    monkeypatch.setattr(spelling, "INDEX_BYTES", bounds[0])
    monkeypatch.setattr(spelling, "STATES", max(bounds[1], 8))
    rng = random.Random(9)
    words = ["".join(rng.choice("abc") for _ in range(rng.choice([6, 7, 8]))) for _ in range(300)]
    starts = np.array([0, 150, 151, 290])
    i, j = spelling.near_pairs(words, starts)
    group = np.repeat(np.arange(4), np.diff(np.append(starts, 300)))
    pairs = set(zip(i.tolist(), j.tolist(), strict=True))
    assert all(one_apart(words[a], words[b]) for a, b in pairs)
    assert {(a, b) for a in range(300) for b in range(300) if group[a] == group[b] and one_apart(words[a], words[b])} <= pairs


# ---- quality classifier ----------------------------------------------------


def test_sum_of_squares_is_all_pairs():
    rng = np.random.default_rng(1)
    found = [factors.features(t, 3) for t in (b"one two three two", b"", b"### $$$ AAA")]
    size = len(factors.STATISTICS) * factors.BINS + factors.BUCKETS
    machine = factors.Machine(np.sort(rng.normal(size=(len(factors.STATISTICS), factors.BINS - 1)), axis=1), 0.3, rng.normal(size=size), rng.normal(size=(size, factors.RANK)))
    ids, x, starts = machine.rows(found)
    for i, (a, b) in enumerate(zip(starts, [*starts[1:], ids.size], strict=True)):
        own, value = ids[a:b], x[a:b]
        line = 0.3 + machine.w[own] @ value + sum(machine.v[own[p]] @ machine.v[own[q]] * value[p] * value[q] for q in range(b - a) for p in range(q))
        assert machine.scores(found)[i] == pytest.approx(1 / (1 + np.exp(-line)))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{n}.parquet") for n in ("documents", "labels"))
    rows = factors.scored(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    assert sum(a.score > b.score for a in good for b in bad) >= 0.95 * len(good) * len(bad)
    assert sum(r.predicted for r in good) >= 0.97 * len(good)


def test_scores_do_not_read_what_they_must_not(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    plain = {r.doc_id: r.score for r in factors.scored(docs, labels).collect()}
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    changed = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.col("doc_id").cast("string"))
    assert {r.doc_id: r.score for r in factors.scored(changed, other).collect()} == plain
    swapped = docs.where(held).select((-F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("was"), "text", "n_chars")
    scores = factors.scored(docs.unionByName(swapped, allowMissingColumns=True), labels).join(swapped.select("doc_id", "was"), "doc_id").collect()
    assert scores and all(r.score == plain[r.was] for r in scores)


@pytest.mark.parametrize("labels", [[], [(1, 1), (3, 1), (None, 0), (4, None)], [(1, 0), (2, 1), (4, 1), (4, 0), (5, 1), (101, 0), (102, 1)]])
def test_classifier_rows_stay(spark, odd, labels):
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    rows = factors.scored(odd, known).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ODD)
    assert all(0 <= r.score <= 1 and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert factors.scored(odd.limit(0), known).count() == 0
