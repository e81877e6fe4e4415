"""Quality rules whose cutoffs carry a guarantee: few good documents are rejected, stratum by stratum.

Base rules come first; what follows concerns the documents that they keep. Signals are shares per document; a cutoff
rejects what lies at or above it, and a rule is one cutoff per signal. For every stratum (language) a quarter of the
labelled documents, by a hash of doc_id, lays down a ladder of rules, each stricter than the one before: signals join
one by one, the most useful first, then the share of good documents that a signal may reject grows. The other
labelled documents, which the ladder has not seen, are the holdout.
The ladder is climbed from the most lenient rule up: a rule is certified if the exact binomial test on the holdout rejects
"more than `risk` of the good documents are rejected by the whole rule", and the climb ends at the first rule
that is not (fixed-sequence testing needs no correction along the ladder). Over strata the error `delta` is divided
(Bonferroni), so that with probability 1 - delta no stratum loses more than `risk` of its good documents to
these rules. Among the certified rules the one with the best trade of bad for good documents is used.

No rule can be certified with fewer than log(delta / strata) / log(1 - risk) good documents in the holdout (217 for four
strata, so about 290 labelled good documents in all); such a stratum rejects nothing beyond the base rules.
"""

from __future__ import annotations

import math
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import schema, staged, texts_of, with_plain_names

RISK, DELTA, GRID, TRADE = 0.02, 0.05, 50, 20
#: One labelled document in TUNING lays down the ladder; shares of `risk` that one signal may reject, rung by rung.
TUNING, ALLOWANCES = 4, (0.0, 0.125, 0.25, 0.5, 1.0)
WINDOW = 8
SYMBOLS, MARKS = b"#*$%&|<>", b"!?~^_=+@/\\;:()[]{}"
CAPITALS = bytes(range(65, 91))
SIGNALS = ("symbols", "repeats", "dup_lines", "capitals", "marks", "long_words")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of `width` words that occur at least twice, the first occurrence included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    # eight bytes a window; equal hashes are compared word by word below
    marks = np.fromiter(map(hash, zip(*(islice(words, i, None) for i in range(width)), strict=False)), np.int64, n)
    values, counts = np.unique(marks, return_counts=True)
    if values.size == n:
        return 0
    places = np.flatnonzero(np.isin(marks, values[counts > 1])).tolist()
    seen = {}
    for i in places:
        seen.setdefault(tuple(words[i : i + width]), []).append(i)
    cover = np.zeros(len(words) + 1, np.int64)
    starts = np.array([i for group in seen.values() if len(group) > 1 for i in group], np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + width, -1)
    return int((np.cumsum(cover) > 0).sum())


def counts_of(text: bytes) -> tuple[int, ...]:
    """COUNTS of a text."""
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    less = lambda some: len(text) - len(text.translate(None, some))
    chars = len(text.decode()) - less(b" \t\n\x0b\x0c\r")
    return len(words), chars, less(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines), less(CAPITALS), less(MARKS)


def counted(docs: DataFrame) -> DataFrame:
    """`docs` with the COUNTS of every text as a struct column `__counts`; null texts have none of anything."""
    kinds = [f for f in docs.schema.fields if f.name != "__counts"]
    names = [f.name for f in kinds]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            table = list(zip(*(counts_of(t) for t in texts_of(batch)), strict=True)) or [()] * len(COUNTS)
            out = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in table], names=list(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))] + [out], [*names, "__counts"])

    out = schema(*[(name, "long") for name in COUNTS])
    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema(*[(f.name, f.dataType) for f in kinds], ("__counts", out)))


def _signals():
    c = lambda name: F.col(f"__counts.{name}").cast("double")
    share = lambda part, whole: F.least(F.lit(1.0), part / F.greatest(whole, F.lit(1.0)))
    words, chars = c("n_words"), c("word_chars")
    return {
        "symbols": share(c("n_symbols"), words), "repeats": share(c("n_repeat_words"), words), "dup_lines": share(c("n_dup_lines"), c("n_lines")),
        "capitals": share(c("n_capitals"), chars), "marks": share(c("n_marks"), words), "long_words": share(chars, words * 40),
    }


def _base_failed():
    words, repeats = F.col("__counts.n_words"), F.col("__counts.n_repeat_words")
    return (words < 20) | (100 * repeats > 30 * words)


def _stratum(column):
    return F.when(column.isNull(), "n").otherwise(F.concat(F.lit("s"), column.cast("string")))


def surely_below(k: int, n: int, risk: float, delta: float) -> bool:
    """Whether k or fewer of n would come up with a chance of delta at most, were the true share `risk`."""
    if n == 0 or k >= n * risk:
        return False
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(risk) + (n - i) * math.log1p(-risk)
    total, i = 0.0, k
    while i >= 0:  # terms fall towards 0; those that no longer count are left out
        term = math.exp(log(i))
        total += term
        if term < 1e-18 and i < k:
            break
        i -= 1
    return total <= delta


def choose(good: np.ndarray, bad: np.ndarray, risk: float, delta: float) -> int:
    """The cutoff (a grid place; GRID rejects nothing) from documents per grid cell.

    good[i], bad[i]: labelled documents whose signal is in cell i, so cutoff i rejects the cells from i on.
    """
    above_good, above_bad = np.cumsum(good[::-1])[::-1], np.cumsum(bad[::-1])[::-1]
    best, gain = len(good), 0
    for cut in range(len(good) - 1, 0, -1):
        if not surely_below(int(above_good[cut]), int(good.sum()), risk, delta):
            break
        here = int(above_bad[cut]) - TRADE * int(above_good[cut])
        if here > gain:
            best, gain = cut, here
    return best


def ladder(good: np.ndarray, bad: np.ndarray, risk: float) -> list[list[int]]:
    """Rules from lenient to strict, a grid place per signal (GRID rejects nothing).

    good[s, i], bad[s, i]: documents whose signal s is in cell i.
    """
    above_good, above_bad = (np.cumsum(x[:, ::-1], axis=1)[:, ::-1] for x in (good, bad))
    total = int(good[0].sum())
    cuts, gains = [], []
    for share in ALLOWANCES:
        row, worth = [], []
        for own_good, own_bad in zip(above_good, above_bad, strict=True):
            cut = int(np.searchsorted(-own_good, -share * risk * total))  # the first cell with few enough good ones
            cut = min(GRID, max(1, cut + (share == 0)))  # the most lenient rules keep a cell's distance
            gain = int(own_bad[cut]) - TRADE * int(own_good[cut]) if cut < GRID else 0
            row.append(cut if gain > 0 else GRID)
            worth.append(gain)
        cuts.append(row)
        gains.append(worth)
    order = sorted(range(len(good)), key=lambda s: (-gains[0][s], s))
    now, rungs = [GRID] * len(good), []
    for row in cuts:
        for signal in order:
            if row[signal] < now[signal]:
                now[signal] = row[signal]
                rungs.append(list(now))
    return rungs


def _per_stratum(table: DataFrame, columns: dict, work) -> DataFrame:
    """`work` on the arrays of `columns` of every stratum; a stratum has a bounded number of rows."""

    def run(rows):
        import pyarrow as pa

        found = work(*[rows.column(name).to_numpy() for name in columns["in"]])
        return pa.table({"stratum": pa.array([rows.column("stratum")[0].as_py()], pa.string()), "rule": pa.array([found], columns["arrow"]())})

    return table.groupBy("stratum").applyInArrow(run, f"stratum string, rule {columns['out']}")


def cutoffs(stats: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(stratum, one cutoff per signal) learned from `stats` (doc_id, lang, __counts) and `labels` (doc_id, quality).

    Documents and labels with a null doc_id, and null qualities, teach nothing; of several labels of a document
    the best counts. The result has one row per stratum that has labels in both parts.
    """
    import pyarrow as pa

    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    cells = F.array(*[F.least(F.lit(GRID - 1), F.floor(x * GRID)).cast("int") for x in _signals().values()])
    tuning = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(TUNING)) == 0
    # the base rules hold anyway: these rules are learned from and promised for the documents beyond them
    taught = stats.where(~_base_failed()).select("doc_id", _stratum(F.col("lang")).alias("stratum"), cells.alias("cells")).join(known, "doc_id")
    taught = staged(taught.select("stratum", "quality", "cells", tuning.alias("tuning")), "labelled-cells")
    strata = max(1, taught.select("stratum").distinct().count())
    sums = (F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
    table = taught.where("tuning").select("stratum", "quality", F.posexplode("cells").alias("signal", "cell"))
    table = table.groupBy("stratum", "signal", "cell").agg(*sums)

    def lay(signal, cell, good, bad):
        counts = np.zeros((2, len(SIGNALS), GRID), np.int64)
        counts[0, signal, cell], counts[1, signal, cell] = good, bad
        return ladder(*counts, risk)

    rungs = _per_stratum(table, {"in": ("signal", "cell", "good", "bad"), "out": "array<array<int>>", "arrow": lambda: pa.list_(pa.list_(pa.int32()))}, lay)
    # at most signals x allowances rules a stratum
    rungs = staged(rungs.select("stratum", F.col("rule").alias("rungs")), "ladders")
    over = lambda rung: F.exists(F.arrays_zip(F.col("cells").alias("x"), rung.alias("c")), lambda p: p["x"] >= p["c"])
    rung = F.array_position(F.transform("rungs", over), True)  # the first that rejects, from 1; 0: none does
    held = taught.where("not tuning").join(rungs, "stratum").groupBy("stratum", "rungs", rung.alias("rung")).agg(*sums)

    def climb(rungs_, rung_, good, bad):
        rules = [list(map(int, r)) for r in rungs_[0]]
        counts = np.zeros((2, len(rules) + 1), np.int64)
        # the last cell is the first rung, cell 0 what no rung rejects; `choose` walks down from the last cell
        cell = np.where(rung_ > 0, len(rules) + 1 - rung_, 0)
        counts[0, cell], counts[1, cell] = good, bad
        cut = choose(*counts, risk, delta / strata)
        return [c / GRID for c in (rules[len(rules) - cut] if cut <= len(rules) else [GRID] * len(SIGNALS))]

    found = _per_stratum(held, {"in": ("rungs", "rung", "good", "bad"), "out": "array<double>", "arrow": lambda: pa.list_(pa.float64())}, climb)
    # staged so that its size is known before it is joined
    return staged(found.select("stratum", *[F.col("rule")[i].alias(name) for i, name in enumerate(SIGNALS)]), "cutoffs")


def _judged(stats: DataFrame, limits: DataFrame) -> DataFrame:
    """`stats` with `__failed` (the base rules) and `__kept`. The join is a broadcast only if Spark finds it small."""
    limits = limits.select(F.col("stratum").alias("__stratum"), F.struct(*SIGNALS).alias("__limits"))
    failed = _base_failed()
    over = F.lit(False)
    for name, signal in _signals().items():
        limit = F.col(f"__limits.{name}")
        # cutoffs are grid places: the cell decides, as it did for the counts
        over = over | F.coalesce((limit < 1) & (F.least(F.lit(GRID - 1), F.floor(signal * GRID)) >= F.round(limit * GRID)), F.lit(False))
    joined = stats.join(limits, _stratum(F.col("lang")) == F.col("__stratum"), "left")
    return joined.withColumn("__failed", failed).withColumn("__kept", ~failed & ~over)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), one row per input row.

    Null texts are empty and fail; a null language is a stratum. Without labels only the base rules reject.
    Repeated rows stay, extra columns are ignored, no rows give no rows.
    """
    stats = staged(counted(docs.select("doc_id", "lang", "text")).drop("text"), "quality")
    judged = _judged(stats, cutoffs(stats, labels))
    return judged.select("doc_id", *[F.col(f"__counts.{name}").alias(name) for name in COUNTS[:5]], F.col("__failed").alias("base_failed"), F.col("__kept").alias("kept"))


@with_plain_names
def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the rules keep, whole, with all columns under their names.

    Null texts are empty and go; a null doc_id is judged but teaches nothing; repeated rows stay or go together; no
    rows give no rows. Texts are not shuffled; rows are written once with their counts, which are made once.
    """
    rows = staged(counted(docs), "quality")
    return _judged(rows, cutoffs(rows.select("doc_id", "lang", "__counts"), labels)).where("__kept").select(*docs.columns)
