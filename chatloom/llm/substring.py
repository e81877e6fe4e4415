"""Substring dedup by fixed-block anchors: repeats of `window` words are cut from all but the first document.

With blocks of (window + 1) // 2 words, every window holds at least one whole block of a grid that starts at a
document's first word. All documents' non-overlapping blocks are the index; every rolling block of every document
probes it. A probe that hits a block of another document is an anchor, and only windows that hold an anchor are
extended: they are compared as whole word sequences, and adjoining ones make up the maximal repeats. A window
goes if its sequence also starts in a document with a smaller doc_id, which needs that least doc_id alone,
never pairs of documents: a passage in a million documents costs a million rows.

Documents are dealt to batches by doc_id. A batch sends each distinct hash once, sorted and packed, to the bucket of
its value; the bucket answers with one bit per hash. So three things are shuffled: texts (once, the exchange is
reused), packed hashes, and bits. Block hashes are only filters and have as many bits as keep false anchors below one
in a thousand at the corpus's size; windows are compared by 96 bits.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import schema, texts_of

WINDOW = 13
BATCH_BYTES = 8 << 20


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def _sequence_hash(words: np.ndarray, starts: np.ndarray | None, width: int, base: int) -> np.ndarray:
    """Hashes of the runs of `width` word hashes at `starts` (all places if None)."""
    total, power = None, np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(width):
            part = (words[k : words.size - width + 1 + k] if starts is None else words[starts + k]) * power
            total = part if total is None else total + part
            power = power * np.uint64(base)
        return _mixed(total)


class Batch:
    """The word hashes of some documents, one after the other."""

    def __init__(self, doc_ids: list, texts: list[bytes], window: int):
        import xxhash

        digest = xxhash.xxh64_intdigest
        self.window, self.block = window, (window + 1) // 2
        self.lengths = np.zeros(len(texts), np.int64)
        parts = []
        for i, text in enumerate(texts):
            words = text.split()
            self.lengths[i] = len(words)
            parts.append(np.fromiter(map(digest, words), np.uint64, len(words)))
        self.words = np.concatenate([*parts, np.zeros(0, np.uint64)])
        self.starts = np.cumsum(self.lengths) - self.lengths
        index = np.repeat(np.arange(len(texts)), self.lengths)
        known = np.array([d is not None for d in doc_ids], bool)
        ids = np.array([d if d is not None else 0 for d in doc_ids], np.int64)
        self.index, self.ids = index, ids[index]
        self.place = np.arange(self.words.size) - self.starts[index]
        left = self.lengths[index] - self.place
        joins = known[index] & (self.lengths[index] >= window)
        self.is_window = joins & (left >= window)
        self.is_block = joins & (left >= self.block)

    def blocks(self, bits: int):
        """Distinct block hashes, for each whether it is on the grid and in two documents; places; which hash at each place."""
        at = np.flatnonzero(self.is_block)
        if not at.size:
            return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, bool), at, at
        hashes = _sequence_hash(self.words, None, self.block, 0x9E3779B97F4A7C15)[at] >> np.uint64(64 - bits)
        order = np.argsort(hashes)
        first, group = _groups(hashes[order])
        ids, grid = self.ids[at][order], (self.place[at] % self.block == 0)[order]
        several = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
        inverse = np.empty(at.size, np.int64)
        inverse[order] = group
        return hashes[order][first], np.logical_or.reduceat(grid, first), several, at, inverse

    def candidates(self, anchors: np.ndarray) -> np.ndarray:
        """Windows that hold an anchor, from the places of anchors."""
        hit = np.zeros(self.words.size + self.window, np.int64)
        hit[anchors + 1] = 1
        total = np.cumsum(hit)
        at = np.flatnonzero(self.is_window)
        return at[total[at + self.window - self.block + 1] - total[at] > 0]

    def windows(self, at: np.ndarray):
        """Distinct sequences of the windows at the given places (two hashes), their least doc_id, and which one each is."""
        if not at.size:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), at
        one = _sequence_hash(self.words, at, self.window, 0xD6E8FEB86659FD93)
        two = _sequence_hash(self.words, at, self.window, 0xA0761D6478BD642F) >> np.uint64(32)
        order = np.lexsort((two, one))
        first, group = _groups(one[order], two[order])
        inverse = np.empty(at.size, np.int64)
        inverse[order] = group
        return one[order][first], two[order][first], np.minimum.reduceat(self.ids[at][order], first), inverse


def _groups(*columns: np.ndarray):
    """First places of runs of equal rows in sorted columns, and the run's number of each row."""
    new = np.zeros(columns[0].size, bool)
    new[:1] = True
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _pack(values: np.ndarray) -> bytes:
    """Numbers as zstd-compressed byte planes, the high ones left out where they are all zero."""
    import zstandard

    planes = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8).T
    used = max([0, *(i + 1 for i in range(8) if planes[i].any())])
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes[:used]).tobytes())


def _unpack(data: bytes, n: int) -> np.ndarray:
    import zstandard

    used = data[0]
    planes = np.zeros((8, n), np.uint8)
    planes[:used] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:], max_output_size=max(1, n * used)), np.uint8).reshape(used, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u8")


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_unpack(data, n), dtype=np.uint64)


def _bits(flags: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.packbits(flags).tobytes())


def _flags(data: bytes, n: int) -> np.ndarray:
    import zstandard

    whole = zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, (n + 7) // 8))
    return np.unpackbits(np.frombuffer(whole, np.uint8), count=n).astype(bool)


def _cuts(values: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where the sorted values of each of `buckets` equal ranges begin and end."""
    edges = [-(-(i << bits) // buckets) for i in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(values, np.array(edges, np.uint64)), [values.size]]).astype(np.int64)


SENT = schema(("bucket", "long"), ("batch", "long"), ("n", "long"), ("a", "binary"), ("b", "binary"), ("c", "binary"))
ANSWER = schema(("batch", "long"), ("bucket", "long"), ("n", "long"), ("bits", "binary"))


def _table(rows: list[tuple], kind):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "binary": pa.binary()}
    columns = list(zip(*rows, strict=True)) or [()] * len(kind.fields)
    return pa.table({f.name: pa.array(list(c), kinds["binary" if f.dataType.typeName() == "binary" else "long"]) for f, c in zip(kind.fields, columns, strict=True)})


def _of_rows(table, *names):
    return zip(*(table.column(n).to_pylist() for n in names), strict=True)


def _answers(rows: list[tuple], flags: np.ndarray) -> list[tuple]:
    """One row of bits for each (batch, bucket, n), in the order in which their entries were put together."""
    out, at = [], 0
    for batch, bucket, n in rows:
        out.append((batch, bucket, n, _bits(flags[at : at + n])))
        at += n
    return out


def _joined(answer) -> np.ndarray:
    """The bits of all buckets of a batch, in the order of buckets."""
    rows = sorted(_of_rows(answer, "bucket", "n", "bits"))
    return np.concatenate([_flags(bits, n) for _, n, bits in rows] + [np.zeros(0, bool)])


def deduplicated(docs: DataFrame, window: int = WINDOW, batch_bytes: int = BATCH_BYTES, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]), one row per input row.

    Words are cut at ASCII white space and compared unchanged; kept words are joined by one space. Rows with equal
    doc_id are never repeats of each other, though one may repeat itself; a row with a null doc_id is kept whole and
    removes nothing elsewhere. Null and short texts have no windows. No rows give no rows; extra columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(1, math.ceil(size / batch_bytes))
    buckets = batches
    bits = min(64, max(32, size.bit_length() + 8))  # a word takes two bytes at least
    dealt = docs.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)))

    def ordered(table):
        # bits speak of places, so every pass must have a batch's rows in the same order, however they arrived
        return table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()

    def batch_of(table) -> Batch:
        return Batch(table.column("doc_id").to_pylist(), texts_of(table), window)

    def probe(table):
        values, grid, several, _, _ = batch_of(ordered(table)).blocks(bits)
        cuts, number = _cuts(values, bits, buckets), table.column("batch")[0].as_py()
        rows = [(i, number, b - a, _pack_sorted(values[a:b]), _bits(grid[a:b]), _bits(several[a:b]))
                for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        return _table(rows, SENT)

    def anchor(table):
        rows = [(batch, bucket, n) for batch, bucket, n in _of_rows(table, "batch", "bucket", "n")]
        parts = [(_unpack_sorted(a, n), _flags(b, n), _flags(c, n)) for n, a, b, c in _of_rows(table, "n", "a", "b", "c")]
        values, grid, several = (np.concatenate(x) for x in zip(*parts, strict=True))
        flags = np.zeros(values.size, bool)
        if values.size:
            order = np.argsort(values, kind="stable")
            first, group = _groups(values[order])
            shared = (np.diff(np.append(first, values.size)) > 1) | np.logical_or.reduceat(several[order], first)
            flags[order] = (shared & np.logical_or.reduceat(grid[order], first))[group]
        return _table(_answers(rows, flags), ANSWER)

    def extend(table, answer):
        if not table.num_rows:
            return _table([], SENT)
        batch, number = batch_of(ordered(table)), table.column("batch")[0].as_py()
        _, _, _, at, inverse = batch.blocks(bits)
        at = batch.candidates(at[_joined(answer)[inverse]])
        one, two, least, _ = batch.windows(at)
        cuts = _cuts(one, 64, buckets)
        rows = [(i, number, b - a, _pack_sorted(one[a:b]), _pack(two[a:b]), _pack(least[a:b].view(np.uint64)))
                for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        mask = np.zeros(batch.words.size, bool)
        mask[at] = True
        rows.append((-1 - number, number, mask.size, _bits(mask), b"", b""))  # goes straight back to its batch
        return _table(rows, SENT)

    def compare(table):
        if table.column("bucket")[0].as_py() < 0:
            return _table([(batch, -1, n, a) for batch, n, a in _of_rows(table, "batch", "n", "a")], ANSWER)
        rows = [(batch, bucket, n) for batch, bucket, n in _of_rows(table, "batch", "bucket", "n")]
        parts = [(_unpack_sorted(a, n), _unpack(b, n), _unpack(c, n).view(np.int64)) for n, a, b, c in _of_rows(table, "n", "a", "b", "c")]
        one, two, least = (np.concatenate(x) for x in zip(*parts, strict=True))
        flags = np.zeros(one.size, bool)
        if one.size:
            order = np.lexsort((two, one))
            first, group = _groups(one[order], two[order])
            flags[order] = np.minimum.reduceat(least[order], first)[group] < least[order]
        return _table(_answers(rows, flags), ANSWER)

    fields = [("doc_id", docs.schema["doc_id"].dataType), ("n_words", "long"), ("n_removed", "long"), ("kept_sha256", "string")]
    fields += [("kept_text", "string")] * with_text

    def cut(table, answer):
        import pyarrow as pa

        if not table.num_rows:
            return pa.table({name: pa.array([], kind) for name, kind in zip([f[0] for f in fields], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()], strict=False)})
        table = ordered(table)
        batch, texts = batch_of(table), texts_of(table)
        own = [(n, bits) for bucket, n, bits in _of_rows(answer, "bucket", "n", "bits") if bucket < 0]
        gone = np.zeros(batch.words.size, bool)
        if own:
            import pyarrow.compute as pc

            at = np.flatnonzero(_flags(own[0][1], own[0][0]))
            _, _, least, inverse = batch.windows(at)
            earlier = _joined(answer.filter(pc.greater_equal(answer.column("bucket"), 0)))
            at = at[earlier[inverse] | (batch.ids[at] > least[inverse])]
            cover = np.zeros(gone.size + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + window, -1)
            gone = np.cumsum(cover)[:-1] > 0
        out = []
        for text, start, n in zip(texts, batch.starts.tolist(), batch.lengths.tolist(), strict=True):
            words, lost = text.split(), gone[start : start + n]
            removed = int(lost.sum())
            if removed:
                words = [w for w, x in zip(words, lost.tolist(), strict=True) if not x]
            kept = b" ".join(words)
            out.append((n, removed, hashlib.sha256(kept).hexdigest()) + ((kept.decode(),) if with_text else ()))
        columns = list(zip(*out, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.table({"doc_id": table.column("doc_id")} | {f[0]: pa.array(c, k) for f, c, k in zip(fields[1:], columns, kinds, strict=False)})

    sent = dealt.groupBy("batch").applyInArrow(probe, SENT)
    anchors = sent.groupBy("bucket").applyInArrow(anchor, ANSWER)
    windows = dealt.groupBy("batch").cogroup(anchors.groupBy("batch")).applyInArrow(extend, SENT)
    repeats = windows.groupBy("bucket").applyInArrow(compare, ANSWER)
    return dealt.groupBy("batch").cogroup(repeats.groupBy("batch")).applyInArrow(cut, schema(*fields))
