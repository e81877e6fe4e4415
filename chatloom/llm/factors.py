"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its words, hashed to BUCKETS with the logarithm of their counts (scaled to length 1), and, one
feature each, the bin of every statistic: how long, capital, marked, repetitive .. the text is, and what `n_chars`
says of it. Every feature has a weight and a vector of RANK numbers; two features together weigh the product of their
vectors, so words act differently in texts of different shape without a weight for every pair. The sum over all
pairs is half the difference of two sums, |sum v x|^2 - sum |v x|^2, and takes time linear in the number of features.

The model is fitted to a bounded sample of labelled rows (SAMPLE, drawn evenly so that scores keep the shares of the
classes) and is a few hundred kilobytes that travel with the tasks; all documents are scored in one pass
without a shuffle.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import schema, split_hash, staged, texts_of

SAMPLE, FOLDS, HELD_OUT = 8_000, 5, 0
CUTOFF = 0.3
BUCKETS, BINS, RANK = 4096, 12, 8
EPOCHS, BATCH, RATE, RIDGE, SEED = 12, 128, 0.02, 2e-4, 13
_MARKS = {"symbols": b"#*$%&|<>", "other_marks": b"!?~^_=+@/;:()[]{}", "capitals": bytes(range(65, 91)), "digits": b"0123456789", "stops": b".,"}
STATISTICS = ("words", "bytes_a_word", *_MARKS, "beyond_ascii", "different_words", "different_pairs", "most_common", "repeated_lines", "words_a_line", "short_words", "n_chars", "n_chars_off")


def statistics(text: bytes, words: list[bytes], counts: Counter, n_chars: int | None) -> list[float]:
    """STATISTICS of a text; what is not known is -1."""
    n = max(len(words), 1)
    lines = [line for line in text.split(b"\n") if line.strip()]
    marks = [(len(text) - len(text.translate(None, some))) / n for some in _MARKS.values()]
    beyond = 0 if text.isascii() else len(text) - len(text.decode("utf-8"))
    pairs = len(set(zip(words, words[1:], strict=False))) / max(len(words) - 1, 1)
    most = max(counts.values(), default=0) / n
    short = sum(c for w, c in counts.items() if len(w) <= 2) / n
    declared = [-1.0, -1.0] if n_chars is None else [np.log1p(max(n_chars, 0)), float(n_chars != len(text) - beyond)]
    return [np.log1p(len(words)), sum(len(w) * c for w, c in counts.items()) / n, *marks, beyond / max(len(text), 1), len(counts) / n, pairs, most,
            1 - len(set(lines)) / max(len(lines), 1), len(words) / max(len(lines), 1), short, *declared]


def features(text: bytes, n_chars: int | None) -> tuple[list[float], np.ndarray, np.ndarray]:
    """Statistics, word buckets and their values."""
    words = text.split()
    counts = Counter(words)
    marks = np.fromiter((zlib.crc32(w.lower()) for w in counts), np.int64, len(counts)) % BUCKETS
    times = np.bincount(marks, weights=np.fromiter(counts.values(), np.float64, len(counts)), minlength=BUCKETS)
    buckets = np.flatnonzero(times)
    values = np.log1p(times[buckets])
    return statistics(text, words, counts, n_chars), buckets, values / max(float(np.sqrt(values @ values)), 1e-9)


class Machine:
    """w0 + sum w x + (|sum v x|^2 - sum |v x|^2) / 2 over the bins of statistics and the word buckets."""

    def __init__(self, edges: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.edges, self.w0, self.w, self.v = edges, w0, w, v

    def rows(self, found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features (numbers, values) of several texts side by side, and where each text's begin."""
        stats = np.array([f[0] for f in found])
        bins = np.stack([np.searchsorted(e, stats[:, i], "right") + i * BINS for i, e in enumerate(self.edges)], axis=1)
        ids = [np.concatenate([b, f[1] + len(STATISTICS) * BINS]) for b, f in zip(bins, found, strict=True)]
        share = 1 / np.sqrt(len(STATISTICS))
        x = [np.concatenate([np.full(len(STATISTICS), share), f[2]]) for f in found]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.concatenate(ids), np.concatenate(x), np.cumsum(sizes) - sizes

    def scores(self, found: list) -> np.ndarray:
        if not found:
            return np.zeros(0)
        ids, x, starts = self.rows(found)
        vx = self.v[ids] * x[:, None]
        sums, squares = np.add.reduceat(vx, starts), np.add.reduceat((vx * vx).sum(axis=1), starts)
        line = self.w0 + np.add.reduceat(self.w[ids] * x, starts) + ((sums * sums).sum(axis=1) - squares) / 2
        return 1 / (1 + np.exp(-np.clip(line, -30, 30)))


def fit(found: list, good: np.ndarray) -> Machine:
    """A machine fitted to features and labels (0 or 1) by Adam on the logistic loss; the same input gives the same machine."""
    stats, size = np.array([f[0] for f in found]), len(STATISTICS) * BINS + BUCKETS
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    rng, share = np.random.default_rng(SEED), (good.sum() + 1) / (good.size + 2)
    machine = Machine(edges, float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.05, (size, RANK)))
    ids, x, starts = machine.rows(found)
    ends = np.append(starts[1:], ids.size)
    states = [[np.zeros_like(p), np.zeros_like(p)] for p in (np.zeros(1), machine.w, machine.v)]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(good.size)
        for begin in range(0, good.size, BATCH):
            own = order[begin : begin + BATCH]
            dense = np.zeros((own.size, size))
            for row, i in enumerate(own.tolist()):
                dense[row, ids[starts[i] : ends[i]]] = x[starts[i] : ends[i]]
            sums = dense @ machine.v
            squared = dense * dense
            line = machine.w0 + dense @ machine.w + ((sums * sums).sum(axis=1) - squared @ (machine.v * machine.v).sum(axis=1)) / 2
            off = (1 / (1 + np.exp(-np.clip(line, -30, 30))) - good[own]) / own.size
            slopes = [np.array([off.sum()]), dense.T @ off + RIDGE * machine.w, dense.T @ (sums * off[:, None]) - (squared.T @ off)[:, None] * machine.v + RIDGE * machine.v]
            step += 1
            moves = []
            for state, slope in zip(states, slopes, strict=True):
                state[0] += 0.1 * (slope - state[0])
                state[1] += 0.001 * (slope * slope - state[1])
                moves.append(RATE * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.999**step)) + 1e-8))
            machine.w0, machine.w, machine.v = machine.w0 - float(moves[0][0]), machine.w - moves[1], machine.v - moves[2]
    return machine


def _fold():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))


def learned(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine | float:
    """The machine of at most `sample` labelled documents outside the held-out fold; one score for all if they are of one class."""
    known = labels.where("doc_id is not null and quality is not null").where(_fold() != HELD_OUT).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = staged(known.orderBy(split_hash("doc_id", seed=13), "doc_id").limit(sample), "quality-sample")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = [features(t, n) for t, n in zip(texts_of(batch), batch.column(1).to_pylist(), strict=True)]
            packed = [b"".join((np.array(s, "<f8").tobytes(), b.astype("<u2").tobytes(), v.astype("<f4").tobytes())) for s, b, v in made]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(packed, pa.binary())], ["doc_id", "quality", "packed"])

    # `sample` rows of two numbers, a bound by parameter: small enough to go to every task
    own = docs.select("doc_id", "text", "n_chars").join(F.broadcast(known), "doc_id").select("text", "n_chars", "doc_id", "quality")
    made = own.mapInArrow(run, schema(*[(f.name, f.dataType) for f in own.schema.fields[2:]], ("packed", "binary")))
    # one row per sampled document, at most 8 + 6 x BUCKETS bytes or so each
    rows = made.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("packed").alias("packed")).toArrow().to_pylist()
    rows.sort(key=lambda r: r["doc_id"])
    good = np.array([float(r["quality"]) for r in rows])
    if np.unique(good).size < 2:
        return float((good.sum() + 1) / (good.size + 2))

    def unpacked(packed: bytes):
        head = 8 * len(STATISTICS)
        n = (len(packed) - head) // 6
        return np.frombuffer(packed, "<f8", len(STATISTICS)).tolist(), np.frombuffer(packed, "<u2", n, head).astype(np.int64), np.frombuffer(packed, "<f4", n, head + 2 * n)

    return fit([unpacked(r["packed"]) for r in rows], good)


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row, in one pass over the texts.

    held_out: crc32(doc_id as text) mod 5 is 0; a null doc_id is in no fold. Null texts count as empty, and an empty
    text has a score by its statistics; a null n_chars is a value of its own. Labels with nulls teach nothing, of
    several labels of a document the best counts, and of several rows of a labelled document one teaches. If all
    labels to learn from are of one class, or there are none, every score is the share of good ones,
    (good + 1) / (all + 2). Rows stay as they are, repeated or not; extra columns are ignored.
    """
    machine = learned(docs, labels, sample)
    held = F.coalesce(_fold() == HELD_OUT, F.lit(False)).alias("held_out")
    if isinstance(machine, float):
        out = docs.select("doc_id", held, F.lit(machine).alias("score"))
        return out.withColumn("predicted", F.when(F.col("score") >= CUTOFF, 1).otherwise(0))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, declared, scores = texts_of(batch), batch.column(3).to_pylist(), []
            for i in range(0, len(texts), 256):
                scores.append(machine.scores([features(t, n) for t, n in zip(texts[i : i + 256], declared[i : i + 256], strict=True)]))
            score = pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), score], ["doc_id", "held_out", "score"])

    own = docs.select("doc_id", held, "text", "n_chars")
    out = own.mapInArrow(run, schema(("doc_id", docs.schema["doc_id"].dataType), ("held_out", "boolean"), ("score", "double")))
    return out.withColumn("predicted", F.when(F.col("score") >= CUTOFF, 1).otherwise(0))
