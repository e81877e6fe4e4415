"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chatloom.llm import chat, embedding, mixing, packing, pii, quality, secrets, simhash, substring, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, bits int, key string, component_id string, taken int, batch int, label int"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LONG = "a long text of many words " * 4000
ROWS = [
    (1, "", "en", "s", 0), (2, None, None, None, None), (None, "one two three four five six seven eight", "en", "s", 1), (None, None, None, None, None),
    (3, LONG, "en", "s", 1), (4, LONG, "fr", "t", 1), (4, LONG, "fr", "t", 1), (5, "\t \n\x0b", "en", None, 1), (6, "x" * 50_000, "en", "s", 1),
    (7, "token = abcdefghijklmnop jo@mail.example.com é\U0001f600 <|endoftext|>", "en", "s", 1), (8, "one two three", "en", "s", 1), (9, "one two three", "en", "s", 1),
]
OPERATORS = {
    "mixing": lambda d, n: mixing.mix(mixing.sizes_of(d)),
    "secrets": lambda d, n: secrets.summary(secrets.scan_documents(d)),
    "cleaned": lambda d, n: secrets.clean_documents(d),
    "simhash": lambda d, n: simhash.near_duplicates(d),
    "pii": lambda d, n: pii.summary(pii.find(d)),
    "quality": lambda d, n: quality.judge(d, n),
    "substring": lambda d, n: substring.deduplicated(d, with_text=True),
    "toxicity": lambda d, n: toxicity.scored(d, n),
}


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([r + (None,) * 7 for r in ROWS], DOCS)


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (3, 1, None), (None, 1, 1), (7, None, 1)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("name", OPERATORS)
def test_rows_stay(name, docs, labels):
    rows = OPERATORS[name](docs, labels).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(name, docs, labels):
    assert OPERATORS[name](docs.limit(0), labels.limit(0)).count() == 0
    assert OPERATORS[name](docs, labels.limit(0)).count() == len(ROWS)


def test_pieces_of_odd_texts(docs):
    rows = packing.packed(docs, VOCABULARY).collect()
    assert sorted(str(r["doc_id"]) for r in rows if r["piece"] == 0) == sorted(str(r[0]) for r in ROWS)
    assert packing.packed(docs.limit(0), VOCABULARY).count() == 0


def test_stages(spark, docs, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert out.count() <= 2 * len(ROWS)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0  # all of these rows fail the base rules


def test_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int, key string, links int"
    odd = [None, [], [0.0, 0.0], [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0]]
    rows = [(i, v, 1) for i, v in enumerate(odd)] + [(10, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (11, [1.0, 0.0], 1), (12, [2.0, 0.0], 1), (12, [2.0, 0.0], 1), (13, [1.0, 0.0, 0.0], 1), (14, [1.0, 0.0], 2)]
    frame = spark.createDataFrame([r + (None, None) for r in rows], kind)
    found = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in embedding.near_duplicates(frame).collect())
    assert [x for x in found if x[1]] == [("11", 2, 11, True), ("12", 2, 11, False), ("12", 2, 11, False)]
    assert ("None", 0, None, False) in found and len(found) == len(rows)
    assert embedding.near_duplicates(frame.limit(0)).count() == 0


def test_conversations(spark):
    rows = [(1, 0, "user", "a<|b\\"), (1, 0, "user", "a<|b\\"), (1, None, None, None), (None, 1, "assistant", "x"), (2, 1, "assistant", ""), (3, 0, "a\nb\\n", "t" * 100_000)]
    frame = chat.chunks(spark.createDataFrame([r + (None,) for r in rows], "conv_id long, turn long, role string, text string, chunk int"))
    back = {r.conv_id: r for r in chat.read_back(frame).collect()}
    assert {k: r.n_turns for k, r in back.items()} == {1: 3, None: 1, 2: 1, 3: 1}
    assert back[None].loss_chars == 1 and chat.examples(frame).count() == 2
    assert chat.read_back(frame.limit(0)).count() == 0 and chat.examples(frame.limit(0)).count() == 0


def test_digests_come_from_examples(spark, monkeypatch):
    """A long conversation over several blocks, repeated and null turns; what examples() leaves out is not trained."""
    rows = [(1, i, "assistant" if i % 2 else "user", f"<|t{i}") for i in range(3000)]
    rows += [(2, None, "assistant", "a\\n"), (2, 0, "assistant", "longer"), (2, 0, "assistant", "b"), (2, 0, "user", "c"), (2, 1, "user", "d")]
    frame = chat.chunks(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = {r.conv_id: r for r in chat.read_back(frame).collect()}
    assert back[1].loss_sha256 == hashlib.sha256("".join(t for *_, role, t in rows[:3000] if role == "assistant").encode()).hexdigest()
    assert (back[1].n_examples, back[2].n_examples, back[2].n_turns, back[2].loss_chars) == (1500, 3, 5, 10)
    for r in chat.rendered(frame.where("conv_id = 2")).collect():
        assert chat.unescaped(r.text[r.loss_start : r.loss_end]) in ("a\\n", "longer", "b")
    examples = chat.examples
    monkeypatch.setattr(chat, "examples", lambda formatted: examples(formatted).where("turn < 1501"))
    less = {r.conv_id: r for r in chat.read_back(frame).collect()}
    assert (less[1].n_examples, less[1].n_turns, less[2].n_examples) == (750, 3000, 2)
    assert less[1].loss_sha256 != back[1].loss_sha256 and less[1].turns_sha256 == back[1].turns_sha256
    monkeypatch.setattr(chat, "examples", lambda formatted: examples(formatted).withColumn("context_end", F.col("context_end") + 1))
    with pytest.raises(Exception, match="no turn begins"):
        chat.read_back(frame).collect()
