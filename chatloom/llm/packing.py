"""Best-fit packing of token pieces, improved by swaps between underfull sequences.

Documents are tokenised, ended by an end id, and cut into pieces of at most `room` tokens. Pieces are dealt
evenly to shards of bounded size; a shard is packed best fit by falling length, then a local search takes its
emptiest sequences one after the other and moves their pieces away: single moves, one-for-one, two-for-one
and one-for-two exchanges, each of which raises the sum of squared fills, until sequences are empty and go.
What shards leave underfull is brought together in fewer shards and searched again, so that sharding costs
about one sequence for each of the last shards.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import schema, split_hash, staged, texts_of

ROOM, END_ID, SHARD_PIECES = 2048, 0, 32_768
#: The emptiest sequences of a shard that the local search tries to empty, and exchanges tried for each.
SEARCHED, EXCHANGES = 64, 256
#: Words whose ids a task remembers, text it encodes at once, and new words given to the tokenizer at once,
#: which takes about a kilobyte for each while it works.
KNOWN_WORDS, TEXT_AT_ONCE, WORDS_AT_ONCE = 300_000, 1 << 22, 20_000

#: Texts with these bytes keep their case: combining marks must join letters first, and control strings are as they are.
KEEPS_CASE = (b"\xcc", b"\xcd", b"<|")


class WordEncoder:
    """Token ids of texts as little-endian uint32 bytes.

    For tokenizers whose ids of a text are those of its words between ASCII white space, one after the other,
    whose normaliser lower-cases, which split a run of letters from what follows it, and which mark the end
    of a run in its last token ("</w>"). Words met before are not encoded again: two generations of words
    are kept, so the frequent ones stay and memory is bounded.
    """

    def __init__(self, definition: str, known_words: int = KNOWN_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.points = {mark: self._ids(mark.decode()).tobytes() for mark in (b".", b",")}
        self.young, self.old, self.limit = {}, {}, known_words

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _runs(self, words: list[bytes], texts: list[str]) -> dict[bytes, bytes]:
        """Ids of words that are runs of letters, many encoded in one call and cut where runs end."""
        out = {}
        for at in range(0, len(words), WORDS_AT_ONCE):
            out.update(self._run_ids(words[at : at + WORDS_AT_ONCE], texts[at : at + WORDS_AT_ONCE]))
        return out

    def _run_ids(self, words: list[bytes], texts: list[str]) -> dict[bytes, bytes]:
        ids = self._ids(" ".join(texts))
        cuts = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if cuts.size != len(words):
            return {w: self._ids(t).tobytes() for w, t in zip(words, texts, strict=True)}
        data, cuts = ids.tobytes(), cuts.tolist()
        return {w: data[a:b] for w, a, b in zip(words, [0, *cuts], cuts, strict=False)}

    def _learn(self, words: set[bytes]) -> None:
        """Put the ids of words that are not among the young ones there."""
        young, old, runs, texts, pointed = self.young, self.old, [], [], []
        for word in words:
            if word in old:
                young[word] = old[word]
            elif word[-1:] in self.points and word[-2:-1].isalnum():  # a mark after an ASCII letter is a token of its own
                pointed.append(word)
            elif (text := word.decode()).isalpha():
                runs.append(word)
                texts.append(text)
            else:
                young[word] = self._ids(text).tobytes()
        for word in pointed:
            bare = word[:-1]
            if bare not in young and bare in old:
                young[bare] = old[bare]
            if bare not in young and bare not in words:
                if (text := bare.decode()).isalpha():
                    runs.append(bare)
                    texts.append(text)
                else:
                    young[bare] = self._ids(text).tobytes()
        young.update(self._runs(runs, texts))
        for word in pointed:
            young[word] = young.get(word[:-1]) + self.points[word[-1:]]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        split = [(t if any(m in t for m in KEEPS_CASE) else t.lower()).split() for t in texts]
        young = self.young
        self._learn(set().union(*split).difference(young))
        out = [b"".join(map(young.__getitem__, words)) for words in split]
        if len(young) > self.limit:
            self.young, self.old = {}, young
        return out


def pieces(docs: DataFrame, vocabulary: str, room: int = ROOM, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the pieces of every document.

    Null and empty texts are one piece that holds the end id. `vocabulary` is a tokenizers file that the
    driver reads; its text, a few MB whatever the corpus, goes to the tasks. ids: little-endian uint32.
    """
    with open(vocabulary, encoding="utf-8") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())
    end = np.array([end_id], "<u4").tobytes()
    docs = docs.select("doc_id", "text")
    fields = [("doc_id", docs.schema["doc_id"].dataType), ("piece", "int"), ("start", "long"), ("length", "long"), ("ids_crc32", "long")]
    fields += [("ids", "binary")] * with_ids

    def run(batches):
        import os
        import zlib

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = WordEncoder(definition.value)

        def rows(ids, texts):
            out = []
            for doc_id, data in zip(ids, encoder.encode(texts), strict=True):
                data += end
                for number, at in enumerate(range(0, len(data), 4 * room)):
                    part = data[at : at + 4 * room]
                    out.append((doc_id, number, at // 4, len(part) // 4, zlib.crc32(part)) + ((part,) if with_ids else ()))
            columns = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], [f[0] for f in fields])

        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: len(fields)]
            ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                ids.append(doc_id)
                texts.append(text)
                size += len(texts[-1])
                if size >= TEXT_AT_ONCE:
                    yield rows(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield rows(ids, texts)

    return docs.mapInArrow(run, schema(*fields))


def best_fit(lengths: np.ndarray, room: int) -> list[list[int]]:
    """Items by falling length, each into the fullest bin that still has room for it."""
    bins, free, open_bins = [], [[] for _ in range(room + 1)], 0  # free[f]: bins with f left; bit f is set if any
    for item in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[item])
        fitting = open_bins >> length
        if fitting:
            left = length + (fitting & -fitting).bit_length() - 1
            target = free[left].pop()
            if not free[left]:
                open_bins &= ~(1 << left)
            bins[target].append(item)
        else:
            left, target = room, len(bins)
            bins.append([item])
        left -= length
        if left:
            free[left].append(target)
            open_bins |= 1 << left
    return bins


def improve(bins: list[list[int]], lengths: np.ndarray, room: int, searched: int = SEARCHED, exchanges: int = EXCHANGES) -> list[list[int]]:
    """Empty underfull bins by exchanges that raise the sum of squared fills; returns the bins that are left."""
    fill = np.array([int(lengths[b].sum()) for b in bins], np.int64)
    under = [i for i in np.argsort(fill, kind="stable").tolist() if fill[i] < room]
    least = -(-int(lengths.sum()) // room)
    gone = 0
    for source in under[:searched]:
        if len(bins) - gone <= least:
            break  # no packing has fewer
        others = np.array([i for i in under if i != source and bins[i]], np.int64)
        for _ in range(exchanges):
            if not bins[source] or not others.size:
                break
            if not _exchange(bins, fill, lengths, room, source, others):
                break
        gone += not bins[source]
    return [b for b in bins if b]


def _exchange(bins, fill, lengths, room, source, others) -> bool:
    """Make the exchange that takes most out of `source`; False if there is none."""
    own = sorted(bins[source], key=lambda x: -int(lengths[x]))
    space = room - fill[others]
    items = np.array([x for i in others.tolist() for x in bins[i]], np.int64)
    holder = np.repeat(others, [len(bins[i]) for i in others.tolist()])
    sizes, left = lengths[items], room - fill[holder]
    best = (0, None)
    for x in own:  # move: into the fullest bin with room
        fits = np.flatnonzero((space >= lengths[x]) & (fill[others] + lengths[x] > fill[source]))
        if fits.size:
            best = (int(lengths[x]), ([x], [], int(others[fits[np.argmin(space[fits])]])))
            break
    groups = [[x] for x in own[:8]] + [[x, y] for i, x in enumerate(own[:8]) for y in own[i + 1 : 8]]
    for group in groups:  # one for one, two for one
        gain = int(lengths[group].sum()) - sizes
        ok = np.flatnonzero((gain > best[0]) & (gain <= left) & (fill[holder] + gain > fill[source]))
        if ok.size:
            at = ok[np.argmax(gain[ok])]
            best = (int(gain[at]), (group, [int(items[at])], int(holder[at])))
    for x in own[:8]:  # one for two neighbours in a bin
        pair = np.flatnonzero(holder[1:] == holder[:-1])
        gain = int(lengths[x]) - sizes[pair] - sizes[pair + 1]
        ok = np.flatnonzero((gain > best[0]) & (gain <= left[pair]) & (fill[holder[pair]] + gain > fill[source]))
        if ok.size:
            at = pair[ok[np.argmax(gain[ok])]]
            best = (int(gain[np.flatnonzero(pair == at)[0]]), ([x], [int(items[at]), int(items[at + 1])], int(holder[at])))
    gain, move = best
    if move is None:
        return False
    out, back, target = move
    bins[source] = [x for x in bins[source] if x not in out] + back
    bins[target] = [x for x in bins[target] if x not in back] + out
    fill[source] -= gain
    fill[target] += gain
    return True


def _pack_shards(dealt: DataFrame, room: int) -> DataFrame:
    """`dealt` packed shard by shard: sequence_id and offset of every row, and whether its sequence is open (not full).

    Rows that are in sequences already keep these where packing them anew takes no fewer.
    """
    kept = [f for f in dealt.schema.fields if f.name not in ("shard", "sequence_id", "offset", "open")]
    again = "sequence_id" in dealt.columns
    order = [f.name for f in kept] + ["sequence_id", "offset"] * again

    def run(table):
        import pyarrow as pa

        table = table.sort_by([(name, "ascending") for name in order])
        lengths = table.column("length").to_numpy()
        bins = improve(best_fit(lengths, room), lengths, room)
        if again:
            _, of = np.unique(table.column("sequence_id").to_numpy(), return_inverse=True)
            by_sequence = np.argsort(of, kind="stable")
            held = [b.tolist() for b in np.split(by_sequence, np.flatnonzero(np.diff(of[by_sequence])) + 1)]
            bins = min(bins, improve(held, lengths, room), key=len)
        sequence, offset, is_open = np.zeros(lengths.size, np.int64), np.zeros(lengths.size, np.int64), np.zeros(lengths.size, bool)
        first = table.column("shard")[0].as_py() << 32
        for number, items in enumerate(bins):
            sequence[items] = first + number
            offset[items] = np.cumsum(lengths[items]) - lengths[items]
            is_open[items] = lengths[items].sum() < room
        table = table.select([f.name for f in kept])
        return table.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).append_column("open", pa.array(is_open))

    fields = [(f.name, f.dataType) for f in kept]
    return dealt.groupBy("shard").applyInArrow(run, schema(*fields, ("sequence_id", "long"), ("offset", "long"), ("open", "boolean")))


def pack(parts: DataFrame, room: int = ROOM, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """`parts` (doc_id, piece, start, length, ids_crc32) with the sequence_id and offset of every piece.

    What the shards leave open is dealt again to shards of the same size, sequence by sequence, and searched
    again, as long as that halves the number of shards. Pieces of `room` tokens are sequences by themselves.
    Equal lengths are placed by doc_id and piece, so that reruns agree; repeated rows are pieces of their own.
    Null doc_ids are dealt by piece, length and checksum, so only equal ones come to one shard. No rows give no rows.
    """
    shards, base, settled = max(1, math.ceil(parts.count() / shard_pieces)), 0, []
    spread = F.pmod(split_hash("doc_id", "piece", "start", "length", "ids_crc32", seed=3), F.lit(shards))
    result = _pack_shards(parts.withColumn("shard", spread), room)
    while shards > 1:
        result = staged(result, "sequences")
        fewer = max(1, math.ceil(result.where("open").count() / shard_pieces))
        if 2 * fewer > shards:
            break
        settled.append(result.where("not open"))
        base, shards = base + shards, fewer
        again = result.where("open").withColumn("shard", base + F.pmod(split_hash("sequence_id", seed=4), F.lit(shards)))
        result = _pack_shards(again, room)
    for done in settled:
        result = result.unionByName(done)
    return result.drop("open")


def packed(docs: DataFrame, vocabulary: str, room: int = ROOM, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all documents."""
    return pack(staged(pieces(docs, vocabulary, room), "pieces"), room, shard_pieces)
