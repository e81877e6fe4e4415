"""Spelling variants of the words of a corpus, found with a bit-sliced position index.

Words are counted over all texts. Two words are near if one inserted, deleted or replaced code point makes one of the
other. The index of a vocabulary holds, for every position and letter, a bitset of the words that have that letter
there; 64 words are one machine word. A word is looked up by walking its letters with four bitsets: `same`, the words
without an error so far, and three of one error: `replaced` (places still level), `shorter` (the looked-up word has one
letter more, so the index is read one position to the left) and `longer` (one position to the right).

One error leaves all letters outside a part of the word alone. The vocabulary is therefore indexed in groups that agree
outside a part: first the two halves of a word. A group of more than GROUP words is dealt again by the halves of its
part, down to parts of one letter, where a group holds words that differ in one letter, or in two against words
one letter shorter: 90 + 90 * 90 words with the 90 letters there are. So every group is bounded without leaving any
word out, whatever the vocabulary, and each pair meets in at least one group.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_sql, schema, staged, texts_of

SHORTEST, OCCURRENCES, DOMINANCE, DAMAGE = 6, 5, 5, 199
#: Words of a group above which it is dealt by smaller parts; no group of one-letter parts is larger.
GROUP = 8192
#: Different words held by a counting task before it hands them on, and bytes of index and of walk states at once.
HELD, INDEX_BYTES, STATES = 200_000, 64 << 20, 1 << 20

# letters are a-z and U+00C0 to U+00FF, two bytes that begin with C3; other two- to four-byte characters part words
_OTHER = re.compile(rb"[\xc2\xc4-\xf4][\x80-\xbf]+")
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b == 0xC3 or 0x80 <= b <= 0xBF else 32 for b in range(256))


def runs_of(text: bytes) -> list[bytes]:
    """The maximal runs of letters of a UTF-8 text, A-Z lower-cased."""
    return (text if text.isascii() else _OTHER.sub(b" ", text)).translate(_LETTERS).split()


def damaged(run: bytes, mark: int) -> str | None:
    """`run` without one letter if the mark says so; None if what is left is too short for a word."""
    word = run.decode()
    if mark % DAMAGE == 0:
        at = mark % len(word)
        word = word[:at] + word[at + 1 :]
    return word if len(word) >= SHORTEST else None


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the words that occur often enough in `docs` (doc_id, text), with their number of occurrences."""
    ids = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"), "text")

    def run(batches):
        import pyarrow as pa

        found = Counter()

        def flush():
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["word", "n"])
            found.clear()

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                start = zlib.crc32(f"{key}:".encode())
                for piece, n in Counter(runs_of(text)).items():
                    if len(piece) >= SHORTEST:  # bytes; letters are as many or fewer
                        word = damaged(piece, zlib.crc32(piece, start))
                        if word is not None:
                            found[word] += n
                if len(found) >= HELD:
                    yield from flush()
        yield from flush()

    counted = ids.mapInArrow(run, schema(("word", "string"), ("n", "long")))
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


def _registered(words: DataFrame) -> DataFrame:
    """`words` (word, n, short, lo, hi) with the key of what they have outside the part [lo, hi) of `short` letters.

    A word of `short` letters may meet words of as many letters and of one more; in those the part is one longer.
    """
    size = F.char_length("word")
    rest = F.substring(F.col("word"), F.col("hi") + 1 + (size - F.col("short")), size)
    key = F.xxhash64("short", "lo", "hi", F.substring(F.col("word"), F.lit(1), F.col("lo")), rest)
    return words.select("word", "n", "short", "lo", "hi", key.alias("key"))


def _halves(lo, hi):
    middle = F.floor((lo + hi) / 2).cast("int")
    return F.array(F.struct(lo.alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), hi.alias("hi")))


def groups(words: DataFrame, most: int = GROUP) -> DataFrame:
    """(word, n, short, lo, hi, key): every word in the groups it belongs to, none of them above `most` words if parts can shrink."""
    size = F.char_length("word")
    both = words.withColumn("short", F.explode(F.array(size, size - 1)))
    zero, whole = F.lit(0), F.col("short")
    start = both.withColumn("part", F.explode(_halves(zero, whole))).select("word", "n", "short", "part.lo", "part.hi")
    current, done = staged(_registered(start), "spelling-groups"), []
    while True:
        large = current.groupBy("key").agg(F.count("*").alias("rows"), F.max(F.col("hi") - F.col("lo")).alias("part"))
        large = staged(large.where((F.col("rows") > most) & (F.col("part") > 1)).select("key"), "spelling-large")
        if large.isEmpty():
            return _union([*done, current])
        done.append(current.join(large, "key", "left_anti").select(*current.columns))
        again = current.join(large, "key", "left_semi").withColumn("half", F.explode(_halves(F.col("lo"), F.col("hi"))))
        current = staged(_registered(again.select("word", "n", "short", "half.lo", "half.hi")), "spelling-groups")


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


class PositionIndex:
    """Bitsets per (lane of 64 words, position, letter) over `words`, an array of codes per word."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray, letters: int):
        count, places = codes.shape
        self.lanes = -(-count // 64)
        # two empty positions on the left and right: reading beyond a word finds no one
        self.bits = np.zeros((self.lanes, places + 3, letters + 1), np.uint64)
        word, place = np.nonzero(codes)
        bit = np.uint64(1) << (word % 64).astype(np.uint64)
        np.bitwise_or.at(self.bits, (word // 64, place + 1, codes[word, place]), bit)
        self.held = np.bitwise_or.reduce(self.bits, axis=2)  # who has any letter there
        all_bits = np.uint64(1) << (np.arange(count) % 64).astype(np.uint64)
        self.all = np.zeros(self.lanes, np.uint64)
        np.bitwise_or.at(self.all, np.arange(count) // 64, all_bits)

    def near(self, codes: np.ndarray, size: int, lanes: np.ndarray) -> np.ndarray:
        """For queries of one `size`, each against one lane, the bitset of the lane's words at exactly one error."""
        same = self.all[lanes]
        replaced, shorter, longer = np.zeros_like(same), np.zeros_like(same), np.zeros_like(same)
        for i in range(size):
            letter = codes[:, i]
            here = self.bits[lanes, i + 1, letter]
            # a letter of the query left out: everyone without an error may go on one position to the left
            shorter = (shorter & self.bits[lanes, i, letter]) | same
            longer = (longer | same) & self.bits[lanes, i + 2, letter]
            replaced = (replaced & here) | (same & ~here & self.held[lanes, i + 1])
            same = same & here
        longer = longer | same  # the letter more comes last
        exact = lambda n: self.held[lanes, n] & ~self.held[lanes, n + 1] if n else ~self.held[lanes, 1]
        return (replaced & exact(size)) | (shorter & exact(size - 1)) | (longer & exact(size + 1))


def near_pairs(words: list[str], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): for every word i the words j near to it in its group; groups begin at `starts` and follow each other."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.append(starts[1:], len(words))
    group = np.repeat(np.arange(starts.size), ends - starts)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    longest = np.maximum.reduceat(sizes, starts).tolist()
    begin = 0
    while begin < starts.size:  # as many whole groups as give an index of bounded size, one at least
        stop, width = begin + 1, longest[begin]
        while stop < starts.size:
            width = max(width, longest[stop])
            if -((starts[begin] - ends[stop]) // 64) * (width + 3) * 96 * 8 > INDEX_BYTES:
                break
            stop += 1
        low, high = int(starts[begin]), int(ends[stop - 1])
        found.append(_near_in(words[low:high], sizes[low:high], group[low:high], low))
        begin = stop
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _near_in(words: list[str], sizes: np.ndarray, group: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    letters, letter = np.unique(flat, return_inverse=True)
    codes = np.zeros((len(words), int(sizes.max())), np.int32)
    codes[np.arange(codes.shape[1]) < sizes[:, None]] = letter + 1
    index = PositionIndex(codes, sizes, letters.size)
    # a query meets the lanes that its group lies in
    number = np.arange(len(words))
    first = np.searchsorted(group, group, "left") // 64
    lanes = (np.searchsorted(group, group, "right") - 1) // 64 - first + 1
    pairs = []
    for size in np.unique(sizes).tolist():
        own = number[sizes == size]
        ends = np.cumsum(lanes[own])
        for cut in range(0, int(ends[-1]), STATES):  # states at once: (query, lane) in order
            at = np.arange(cut, min(cut + STATES, int(ends[-1])))
            which = np.searchsorted(ends, at, "right")
            query = own[which]
            lane = first[query] + at - (ends[which] - lanes[query])
            bits = index.near(codes[query, :size], size, lane)
            some = np.flatnonzero(bits)
            row, bit = np.nonzero(np.unpackbits(bits[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            pairs.append((query[some[row]], lane[some[row]] * 64 + bit))
    i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
    return i + low, j + low


def links(words: DataFrame, most: int = GROUP) -> DataFrame:
    """(word, near, near_n): every word of `words` (word, n) with each word near to it, once."""
    dealt = groups(words, most).select("key", "word", "n").repartition("key").sortWithinPartitions("key", "word")

    def run(batches):
        import pyarrow as pa

        def pairs(keys, spelled, counts):
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            size = np.diff(np.append(starts, keys.size))
            many = np.repeat(size > 1, size)  # a word alone in its group has no one near
            spelled, counts = [w for w, m in zip(spelled, many.tolist(), strict=True) if m], counts[many]
            if spelled:
                size = size[size > 1]
                i, j = near_pairs(spelled, np.cumsum(size) - size)
                names = pa.array(spelled, pa.string())
                yield from pa.table({"word": names.take(pa.array(i)), "near": names.take(pa.array(j)), "near_n": pa.array(counts[j], pa.int64())}).to_batches(max_chunksize=100_000)

        keys, spelled, counts = np.zeros(0, np.int64), [], np.zeros(0, np.int64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            spelled += batch.column(1).to_pylist()
            counts = np.concatenate([counts, batch.column(2).to_numpy()])
            last = int(np.searchsorted(keys, keys[-1])) if keys.size else 0  # the last group may go on
            if last >= GROUP:
                yield from pairs(keys[:last], spelled[:last], counts[:last])
                keys, spelled, counts = keys[last:], spelled[last:], counts[last:]
        if keys.size:
            yield from pairs(keys, spelled, counts)

    found = dealt.mapInArrow(run, schema(("word", "string"), ("near", "string"), ("near_n", "long")))
    return found.distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of `forms` (word, form): the last form on the way. Every round doubles the steps behind it."""
    ways = staged(forms.select("word", F.col("form").alias("root")), "spelling-ways")
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("on"))
        ways = staged(ways.join(further, "root", "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), "spelling-ways")
        if ways.where("moved").isEmpty():
            return ways.drop("moved")
        ways = ways.drop("moved")


def variants(docs: DataFrame, most: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word of the vocabulary.

    Null and empty texts have no words; a null doc_id is spelled `null` where a run's mark is made. Repeated rows
    count as often as they are there, extra columns are ignored, no rows give no rows. Of near words with the same
    number of occurrences the smallest in code-point order is the form.
    """
    words = staged(vocabulary(docs.select("doc_id", "text")), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = links(words, most).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    strong = -F.col("best.less") >= DOMINANCE * F.col("n")
    known = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, F.col("best.form")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n"))
    known = staged(known, "spelling-forms")
    roots = _roots(known.where("form is not null"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def sql() -> str:
    """The same rows in DuckDB's SQL; near words are those that agree once a letter is left out."""
    return f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM (
    SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS r FROM documents)),
c AS (SELECT doc_id, r, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || r AS b FROM runs WHERE length(r) >= {SHORTEST} GROUP BY doc_id, r),
h AS (SELECT r, n, {crc32_sql("b")} AS h FROM c),
w AS (SELECT CASE WHEN h % {DAMAGE} = 0 THEN r[1:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(n) >= {OCCURRENCES}),
cut AS (SELECT word, n, i, word[1:i] || word[i + 2:] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN v b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min({{'less': -near_n, 'form': near}}) AS best FROM near GROUP BY word),
f AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= {DOMINANCE} * n THEN best.form END AS form,
  CASE WHEN -best.less >= {DOMINANCE} * n THEN -best.less END AS form_n FROM v LEFT JOIN best ON v.word = best.word),
way AS (SELECT word, word AS at FROM f UNION ALL SELECT way.word, f.form FROM way JOIN f ON way.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, way.at AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM f JOIN way ON way.word = f.word JOIN f l ON l.word = way.at AND l.form IS NULL"""
