"""Results against brute force, round trips and held-out accuracy."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import SF
from tokenizers import Tokenizer

import corpus_pipeline
from chatloom.llm import chat, components, embedding, mixing, packing, pii, quality, secrets, simhash, substring, toxicity, unions
from chatloom.session import shared_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 32))
    v = np.concatenate([base, base[:30] + rng.normal(size=(30, 32)) * 0.12, base[:10], base[:30] + rng.normal(size=(30, 32)) * 0.2]).astype(np.float32)
    labels = (np.arange(len(v)) % 3 == 0).astype(int)
    frame = spark.createDataFrame([(i, [float(y) for y in x], int(k)) for i, (x, k) in enumerate(zip(v, labels, strict=True))], "vec_id long, embedding array<float>, label int")
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    root = np.arange(len(v))
    unions.merge(root, *np.nonzero(near))
    assert near.any()
    for tile in (8, 4096):
        found = {r.vec_id: (r.n_links, r.component_id) for r in embedding.near_duplicates(frame, tile_rows=tile).collect()}
        assert found == {i: (int(near[i].sum()), int(root[i])) for i in range(len(v))}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    star = {r.a: r.b for r in components.stars(links).collect()}
    assert star == {i: 0 for i in range(1, 61)} | {101: 100}


def test_mix(docs, texts):
    rows = mixing.mix(mixing.sizes_of(docs)).collect()
    again = mixing.mix(mixing.sizes_of(docs.repartition(7))).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    sources = {}
    for r in rows:
        assert r["size"] == len(WORD.findall(texts[r.doc_id])) and r.taken in (0, r["size"], 2 * r["size"])
        sources.setdefault(r.source, [0, r.source_size, r.target])[0] += r.taken
    names, left = sorted(sources), 1.5 * sum(s[1] for s in sources.values())
    weight, open_, goal = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}, set(names), {}
    while open_:
        unit = left / sum(weight[n] for n in open_)
        full = {n for n in open_ if 2 * sources[n][1] <= unit * weight[n]}
        for n in full or open_:
            goal[n] = 2.0 * sources[n][1] if full else unit * weight[n]
            left -= goal[n]
        open_ -= full or set(open_)
    for n, (taken, _, target) in sources.items():
        assert target == pytest.approx(goal[n]) and abs(taken - target) <= 0.05 * target  # ten documents a source


@pytest.mark.parametrize("seed", range(4))
def test_best_sum_against_all_choices(seed):
    rng = np.random.default_rng(seed)
    lengths, counts, budget = rng.choice(np.arange(1, 40), 5, replace=False), rng.integers(0, 4, 5), int(rng.integers(1, 120))
    sums = (sum(c * x for c, x in zip(pick, lengths, strict=True)) for pick in itertools.product(*(range(c + 1) for c in counts)))
    taken = mixing.best_sum(lengths, counts, budget)
    assert (taken <= counts).all() and (taken * lengths).sum() == max(s for s in sums if s <= budget)


def test_packing_round_trip(docs, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = packing.packed(docs, path, shard_pieces=100).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for key, text in texts.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        cut = [(i, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for i, at in enumerate(range(0, len(ids), 2048))]
        assert sorted(by_doc[key]) == cut
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048 and len(ends) <= 1.05 * -(-sum(ends.values()) // 2048) + 4


def test_odd_words_encode_alike():
    definition = open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read()
    encoder, tokenizer = packing.WordEncoder(definition, known_words=20), Tokenizer.from_str(definition)
    random.seed(7)
    signs = ["Abc", "it's", "J̌", "É", "ß", "İ", "Σας", ".", ",", "!", " ", "\n", " ", "\x1c", "\x01", "<|endoftext|>", "<|ENDOFTEXT|>", "12", "ab.", "漢字", "́", "…"]
    texts = ["".join(random.choices(signs, k=random.randint(0, 12))) for _ in range(400)]
    got = [np.frombuffer(x, "<u4").tolist() for i in range(0, 400, 40) for x in encoder.encode([t.encode() for t in texts[i : i + 40]])]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def pack_lengths(spark, lengths, room, shard_pieces):
    """Pieces per sequence of a packing of these lengths, whose places are checked."""
    rows = [(i, 0, 0, int(n), i) for i, n in enumerate(lengths)]
    parts = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(parts, room, shard_pieces).collect()
    assert sorted((r.doc_id, r.length) for r in got) == [(i, n) for i, _, _, n, _ in rows]
    sequences = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sum(sequences.setdefault(r.sequence_id, []))
        sequences[r.sequence_id].append(r.length)
    assert all(sum(s) <= room for s in sequences.values())
    return sequences


def test_search_lowers_best_fits_number(spark):
    lengths = np.array([4, 4, 7, 6, 7, 4, 5, 3, 3, 3])
    assert len(packing.best_fit(lengths, 12)) == 5
    assert len(pack_lengths(spark, lengths, 12, 100)) == 4


def test_open_sequences_of_many_shards_are_searched_together(spark):
    random.seed(5)
    lengths = [random.randint(1, 60) for _ in range(2000)]
    least = -(-sum(lengths) // 100)
    got = pack_lengths(spark, lengths, 100, 50)
    last = {number >> 32 for number, held in got.items() if sum(held) < 100}
    assert len(got) <= least + len(last) and len(last) < 5  # of 40 shards
    rough = [random.randint(30, 70) for _ in range(600)]  # leaves many open sequences, so rounds end early
    one = len(pack_lengths(spark, rough, 100, 1000))
    assert len(pack_lengths(spark, rough, 100, 50)) <= 1.05 * one


def test_exchanges_empty_bins():
    lengths = np.array([60, 30, 70, 40])
    bins = packing.improve([[0, 1], [2], [3]], lengths, 100)
    assert len(bins) == 2 and sorted(sum(bins, [])) == list(range(4))
    assert all(lengths[b].sum() <= 100 for b in bins)


def _joined(found):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()


def _secrets(text):
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(secrets.ASSIGN, text) if len(m[2]) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return _joined([(k, a, b) for a, _, k, b in sorted(out)])


def _luhn(digits):
    twice = [2 * int(d) - 9 * (int(d) > 4) for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(twice)) % 10 == 0


def _pii(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and _luhn(digits(m))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return _joined(out)


@pytest.fixture(scope="module")
def noisy(spark, texts):
    random.seed(5)
    parts = ["password", "Token", "api_key", "=", ":", " ", '"', "abc", "secret", "AKIA", "AKIAABCDEFGHIJ", "0123456789abcdef", "é", "\U0001f600", "+1 ", "555", "-", "(", ")", ".", "1.2.3.4", "a@b.c", "_", "4111 1111 1111 1111", "\n"]
    odd = ["".join(random.choices(parts, k=random.randint(0, 25))) for _ in range(800)]
    rows = [*texts.values(), *odd, ""]
    path = shared_path(spark, "noisy")
    spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(8).write.parquet(path)
    return spark.read.parquet(path), rows


def test_secrets_against_python(noisy):
    frame, rows = noisy
    found = secrets.summary(secrets.scan_documents(frame)).collect()
    assert {r.doc_id: r.base_sha256 for r in found} == {i: _secrets(t) for i, t in enumerate(rows)}


def test_ledger_scans_only_what_is_new(spark, noisy):
    frame, ledger = noisy[0], shared_path(spark, "ledger")
    rows = lambda: spark.read.parquet(ledger).count()
    secrets.scan(frame, ledger)
    first = rows()
    secrets.scan(frame.union(frame), ledger)
    assert rows() == first == frame.select("text").distinct().count()
    raised = (*secrets.RULES[:2], secrets.Rule("hex", 2, "[0-9a-f]{20,}"))
    secrets.scan(frame, ledger, raised)
    assert rows() == 2 * first
    again = spark.read.parquet(ledger).where("rules = array('hex@2')").count()
    assert again == first and {f.version for r in secrets.findings(frame, ledger, raised).collect() for f in r.findings if f.kind == "hex"} <= {2}


def test_pii_against_python(noisy):
    frame, rows = noisy
    found = pii.summary(pii.find(frame)).collect()
    assert {r.doc_id: r.base_sha256 for r in found} == {i: _pii(t) for i, t in enumerate(rows)}


def test_pii_adds_spans(spark):
    texts = ["call phone 212-555-0199 now", "ssn 234-56-7890", "ref 000-000-0000", "mail a@b.com"] * 30
    found = pii.summary(pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    spans = {texts[r.doc_id]: r.spans for r in found}
    assert "local_phone:11:23" in spans[texts[0]] and "tax_number" in spans[texts[1]] and not spans[texts[2]]


def test_simhash_against_all_pairs(spark, docs, texts):
    ids = list(texts)
    prints = np.array([simhash.fingerprint_bits(texts[i].encode(), 3) for i in ids], np.int64).view(np.uint64)
    root = np.arange(len(ids))
    unions.merge(root, *np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3))
    least = {}
    for i, r in zip(ids, root, strict=True):
        least[r] = min(i, least.get(r, i))
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, shard_points=16).collect()}
    assert found == {i: least[r] for i, r in zip(ids, root, strict=True)}


def test_fingerprint_by_hand():
    import xxhash

    h = [xxhash.xxh64_intdigest(s, 42) for s in (b"a b c", b"b c d", b"c d c")]
    bits = sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > 3)
    assert simhash.fingerprint_bits("A b\nC  d c".encode(), 3) & (2**64 - 1) == bits
    assert simhash.fingerprint_bits(b"", 3) == 0


def test_trees_lose_no_pair(spark):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 300, dtype=np.int64)
    near = base ^ np.array([sum(1 << int(b) for b in rng.choice(63, rng.integers(1, 5), replace=False)) for _ in base])
    values = np.unique(np.concatenate([base, near]))
    links = simhash.near_links(spark.createDataFrame([(int(v),) for v in values], "bits long"), shard_points=8).collect()
    place, root, true = {int(v): i for i, v in enumerate(values)}, np.arange(values.size), np.arange(values.size)
    if links:
        unions.merge(root, *np.array([(place[r.a], place[r.b]) for r in links]).T)
    u = values.view(np.uint64)
    unions.merge(true, *np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 3))
    assert (root == true).all() and len(links) > 100


def test_near_copies(spark, texts):
    random.seed(2)
    rows, own = [], [t for t in texts.values() if len(t.split()) > 60][:40]
    for i, t in enumerate(own):
        words = t.split()
        changed = words[:]
        for at in random.sample(range(len(words)), max(1, len(words) // 60)):
            changed[at] = "changed"
        rows += [(3 * i, t), (3 * i + 1, " ".join(changed)), (3 * i + 2, t)]
    found = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets, missed = {i: set(zip(*(t.lower().split()[k:] for k in range(5)))) for i, t in rows}, 0
    for i in range(0, len(rows), 3):
        assert found[i] == found[i + 2]
        x, y = sets[i], sets[i + 1]
        missed += len(x & y) >= 0.8 * len(x | y) and found[i] != found[i + 1]
    assert missed == 0


def test_near_copies_beside_their_leaders(spark):
    """Families on one template just under 0.8: every pair in a group together is compared, whoever leads the group."""
    rng, rows = random.Random(7), []
    word = lambda: f"w{rng.randrange(10**9)}"
    template = [word() for _ in range(300)]
    for i in range(60):
        own = [word() for _ in range(38)]
        rows.append((i, " ".join(template + own)))
        if i >= 45:
            rows.append((100 + i, " ".join(template + own[:3] + [word() for _ in range(35)])))
    sets = {i: simhash.shingle_set(t.encode(), 5) for i, t in rows}
    views = {i: simhash.sampled_fingerprints(x) for i, x in sets.items()}
    bits = {i: simhash.fingerprint_bits(t.encode(), 5) for i, t in rows}
    found = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = 0
    for a, b in itertools.combinations(sets, 2):
        common = np.intersect1d(sets[a], sets[b], assume_unique=True).size
        if common >= 0.8 * (sets[a].size + sets[b].size - common) and ((views[a] == views[b]).any() or ((bits[a] ^ bits[b]) & (2**64 - 1)).bit_count() <= 3):
            linked += 1
            assert found[a] == found[b]
    assert linked > 10 and len(set(found.values())) > 1


def test_rare_pairs_are_exact(spark):
    """Every pair of the similarity, and of other components, comes out of the join; a common template does not multiply its rows."""
    rng, rows = random.Random(11), []
    template = [f"t{i}" for i in range(60)]
    for i in range(120):
        words = template[:]
        for at in rng.sample(range(60), rng.choice([0, 1, 1, 2, 3, 9])):
            words[at] = f"x{rng.randrange(5)}"
        rows.append((i, i % 3 if i % 4 else i, " ".join(words)))
    rows += [(200, 200, "a b"), (201, 201, "a b c d e"), (202, 202, ""), (203, 203, None), (204, 204, "A B"), (205, 205, " ".join(f"y{i}" for i in range(19))), (206, 206, " ".join(f"y{i}" for i in range(16)))]
    found = {(r.a, r.b) for r in simhash._rare_pairs(spark.createDataFrame(rows, "first long, component_id long, text string"), 5, 0.8).collect()}
    sets = {i: (c, simhash.shingle_set((t or "").encode(), 5)) for i, c, t in rows}
    alike = set()
    for b, a in itertools.combinations(sorted(sets), 2):
        (one, x), (two, y) = sets[a], sets[b]
        common = np.intersect1d(x, y, assume_unique=True).size
        if common and one != two and 5 * common >= 4 * (x.size + y.size - common):
            alike.add((a, b))
    assert alike <= found and len(alike) > 20 and (204, 200) in found and (206, 205) in found
    assert len(found) < 2 * len(alike)


@pytest.mark.parametrize("sizes", [(0, 0), (1, 3), (900, 1000)])
def test_parity_maps_never_overstate(sizes):
    rng = np.random.default_rng(5)
    x, y = (np.unique(rng.integers(0, 1500, n).astype(np.uint64)) for n in sizes)
    differ = sum(int(a ^ b).bit_count() for a, b in zip(simhash.parity_map(x).view(np.uint64).tolist(), simhash.parity_map(y).view(np.uint64).tolist(), strict=True))
    assert differ <= np.setxor1d(x, y).size


def test_counts_against_python(texts):
    for text in [*texts.values(), "a b c d e f g h " * 3, "x\n\nx\n x\n"]:
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        seen, cover = {}, set()
        for i in range(len(words) - 7):
            seen.setdefault(tuple(words[i : i + 8]), []).append(i)
        for places in seen.values():
            for i in places if len(places) > 1 else []:
                cover.update(range(i, i + 8))
        assert quality.counts_of(text.encode())[:5] == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover))


def test_certified_cutoffs_hold():
    from math import comb

    for k, n, risk in ((0, 100, 0.05), (2, 300, 0.03), (9, 300, 0.03)):
        tail = sum(comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1))
        for delta in (tail * 1.01, tail * 0.99):
            assert quality.surely_below(k, n, risk, delta) == (k < n * risk and tail <= delta)
    good, bad = np.zeros(50, int), np.zeros(50, int)
    good[0], bad[40], good[30] = 5000, 200, 40
    assert 30 < quality.choose(good, bad, 0.01, 0.01) <= 40
    assert quality.choose(good // 1000, bad, 0.01, 0.01) == 50


def test_chat_round_trip(spark):
    frame = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "<|im_end|><|im_start|>assistant ok \\n <\\|"
    rows = frame.union(spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], frame.schema))
    chunks = chat.chunks(rows)
    back = {r.conv_id: r for r in chat.read_back(chunks).collect()}
    turns = {}
    for r in sorted(rows.collect(), key=lambda r: (r.conv_id, r.turn)):
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    for key, own in turns.items():
        trained = "".join(t for role, t in own if role == "assistant")
        assert (back[key].n_turns, back[key].loss_chars) == (len(own), len(trained))
        assert back[key].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert back[key].loss_sha256 == hashlib.sha256(trained.encode()).hexdigest()
    written = chat.rendered(chunks).collect()
    assert len(written) == sum(role == "assistant" for own in turns.values() for role, _ in own)
    for r in written:
        assert chat.unescaped(r.text[r.loss_start : r.loss_end]) == turns[r.conv_id][r.turn][1]
        assert r.text.count("<|im_start|>") == r.turn + 1
    assert sorted(map(tuple, chat.examples(chunks, block=2).collect())) == sorted(map(tuple, chat.examples(chunks).collect()))


@pytest.mark.parametrize("batch_bytes", [20_000, 8 << 20])
def test_substrings_against_python(spark, docs, texts, batch_bytes):
    rng = random.Random(4)
    extra = {10_000 + i: " ".join(rng.choices("abc", k=rng.randint(0, 80))) for i in range(60)}
    words = {i: t.split(" ") if i >= 10_000 else WORD.findall(t) for i, t in (texts | extra).items()}
    words = {i: [w for w in own if w] for i, own in words.items()}
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(list(extra.items()), "doc_id long, text string"))
    first, expected = {}, {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    for i, own in words.items():
        gone = set()
        for k in range(len(own) - 12):
            if first[tuple(own[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = " ".join(w for k, w in enumerate(own) if k not in gone)
        expected[i] = (len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.deduplicated(frame, batch_bytes=batch_bytes).collect()}
    assert found == expected and sum(x[1] for x in expected.values()) > 0


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(6)
    plain, rude = ["garden", "river", "letters", "morning", "quiet", "bridges", "window"], ["grumblo", "snarkle"]
    rows, labels = [], []
    for i in range(600):
        toxic = int(i % 4 == 0)
        own = rng.choices(plain, k=60)
        for at in rng.sample(range(60), 4 if toxic else 0):
            own[at] = rng.choice(rude) + rng.choice(["s", "ing", "ed", "est", "y"])
        rows.append((i, " ".join(own)))
        labels.append((i, 1, toxic))
    out = toxicity.scored(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == labels[r.doc_id][2] for r in held) / len(held) > 0.97


def test_toxicity_counts_every_run(spark):
    """More runs than any list of the most frequent ones would keep, against one model of all of them in memory."""
    rng = random.Random(16)
    rows = [(i, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(200)) + " zq" * (i % 2)) for i in range(600)]
    frame, labels = (spark.createDataFrame(r, s) for r, s in ((rows, "doc_id long, text string"), ([(i, 1, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")))
    fold, texts = [zlib.crc32(str(i).encode()) % 5 for i, _ in rows], [t.encode() for _, t in rows]

    def counts(of):
        words = toxicity.Words([texts[i] for i in of])
        keys, _, lengths = words.runs()
        return keys, np.repeat(np.bincount(np.concatenate(words.texts), minlength=len(words.different)), lengths)

    (t, nt), (o, no) = (counts([i for i in range(600) if fold[i] in (1, 2, 3) and i % 2 == c]) for c in (1, 0))
    runs, sums = toxicity._summed(np.concatenate([t, o]), np.concatenate([nt, 0 * no]), np.concatenate([0 * nt, no]))
    assert runs.size > 1 << 18
    keys, n = counts(range(600))
    shared, (total,) = toxicity._summed(keys & np.uint64(0xFFFFFFFF), n)
    model, features = toxicity.Model(runs, *sums, shared, total), []
    for text in texts:
        words = toxicity.Words([text])
        keys, starts, _ = words.runs()
        scores = np.add.reduceat(model.ratios(keys), starts)[words.texts[0]]
        features.append((scores.mean(), max(scores[k : k + 32].sum() / 32 for k in range(len(scores) - 31))))
    known, y = np.array([f for f, k in zip(features, fold) if k == 4]), np.array([i % 2 for i in range(600) if fold[i] == 4], float)
    centre, scale, w = toxicity._curve(known, y)
    expected = 1 / (1 + np.exp(-np.clip((np.array(features) - centre) / scale @ w[:2] + w[2], -30, 30)))
    for settings in ({}, {"portion_bytes": 50_000}):
        found = {r.doc_id: r.score for r in toxicity.scored(frame, labels, **settings).collect()}
        assert np.allclose([found[i] for i in range(600)], expected, rtol=1e-6, atol=1e-9)


def test_kneser_ney_sums_to_one():
    runs = np.array([int.from_bytes(bytes([1] * 5) + w[:2]) for w in (b"ab", b"ab", b"ac", b"bc")], np.uint64)
    keys, (counts,) = toxicity._summed(runs, np.ones(4))
    model = toxicity.Model(keys, counts.astype(float), counts.astype(float), np.unique(keys & np.uint64(0xFFFFFFFF)), np.ones(3))
    assert np.allclose(model.ratios(keys), 0)


def test_pipeline_stages_against_brute_force(spark, docs, texts):
    first = corpus_pipeline.quality_rules(spark, docs, SF)
    kept = {r.doc_id for r in first.collect()}
    judged = {r.doc_id: r.kept for r in quality.judge(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert kept == {i for i, k in judged.items() if k}
    second = corpus_pipeline.near_dedup(spark, first, SF)
    own = {r.doc_id for r in second.collect()}
    sets = {i: set(simhash.shingle_set(texts[i].encode(), 5).tolist()) for i in kept}
    alike = [(a, b) for a, b in itertools.combinations(sorted(kept), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    place = {i: n for n, i in enumerate(sorted(kept))}
    root = np.arange(len(kept))
    if alike:
        unions.merge(root, *np.array([(place[a], place[b]) for a, b in alike]).T)
    assert own == {i for i, n in place.items() if root[n] == n}
    third = corpus_pipeline.secret_scan(spark, second, SF)
    for r in third.collect():
        assert (_secrets(r.text) == _joined([])) and (r.text == texts[r.doc_id] or _secrets(texts[r.doc_id]) != _joined([]))
