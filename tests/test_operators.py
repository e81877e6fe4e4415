import pytest
from pyspark.sql import functions as F

from chatloom.functions import human_count, human_size, relative_name, strip, suffix
from chatloom.operators import catalog, chat, generate, render, sampling


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "size, expected",
    [(0, "0 B"), (1023, "1023 B"), (1280, "1.2 KB"), (1408, "1.4 KB"), (1048576, "1.0 MB"), (3 * 1024**3, "3.0 GB"), (1048575, "1024.0 KB")],
)
def test_human_size(spark, size, expected):
    assert one(spark, human_size(F.lit(size))) == expected


def test_sizes_and_counts_like_python(spark):
    numbers = [1, 49, 50, 350, 650, 1_250, 99_950, 123_456, 350_000, 1_000_001, 1_050_000, 2_350_000_000, 7_000_000_000_000]
    df = spark.createDataFrame([(n,) for n in numbers], "n bigint")
    rows = {r["n"]: (r["c"], r["s"]) for r in df.select("n", human_count(F.col("n")).alias("c"), human_size(F.col("n")).alias("s")).collect()}

    def count(n):
        return f"{n / 1e9:.1f}B" if n > 1e9 else f"{n / 1e6:.1f}M" if n > 1e6 else f"{n / 1e3:.1f}K"

    def size(n):
        if n < 1024:
            return f"{n} B"
        for unit, name in ((1024, "KB"), (1024**2, "MB"), (1024**3, "GB")):
            if n < unit * 1024 or name == "GB":
                return f"{n / unit:.1f} {name}"

    assert rows == {n: (count(n), size(n)) for n in numbers}


def test_strip_is_unicode_aware(spark):
    assert one(spark, strip(F.lit("　\x1c\n a b \t\xa0"))) == "a b"


@pytest.mark.parametrize("path, expected", [("a/B.TXT", "txt"), ("a/.hidden", ""), ("a/x.tar.gz", "gz"), ("none", "")])
def test_suffix(spark, path, expected):
    assert one(spark, suffix(F.lit(path))) == expected


def test_relative_name(spark):
    assert one(spark, relative_name(F.lit("file:/base/sub\\x.txt"), "/base")) == "sub/x.txt"


# ---- rendering and chat ---------------------------------------------------

TURNS = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "tool", "t"), (1, 3, "assistant", "b"), (1, 4, "user", None)]


def shown(role, text):
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


@pytest.fixture
def conversation(spark):
    return spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string")


def test_unknown_role_is_left_out(conversation):
    row = chat.fold_text(conversation).first()
    assert row["text"] == shown("system", "s") + shown("user", "a") + shown("assistant", "b") + shown("user", "")
    assert (row["n_messages"], row["n_dropped"]) == (5, 1)


def test_missing_role_is_user(spark):
    messages = F.array(F.struct(F.lit(None).cast("string").alias("role"), F.lit("x").alias("content")))
    assert one(spark, render.render(messages)) == shown("user", "x")
    assert one(spark, render.dropped_messages(messages)) == 0


def test_system_upsert(spark):
    messages = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in
                         [("system", "old"), ("user", "a"), ("system", "older")]])
    rows = one(spark, chat.upsert_system(messages, "new"))
    assert [(m["role"], m["content"]) for m in rows] == [("system", "new"), ("user", "a")]


def test_system_prompt_only_on_request(spark):
    assert one(spark, render.single_prompt(F.lit("q"))) == shown("user", "q") + "<|im_start|>assistant\n"
    assert one(spark, render.single_prompt(F.lit("q"), system="s")).startswith(shown("system", "s"))


@pytest.fixture(scope="module")
def long_conversation(spark):
    """One conversation with a third of all turns."""
    hot = [(0, t, "user" if t % 2 == 0 else "assistant", f"h{t}") for t in range(700)]
    rest = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c}-{t}") for c in range(1, 141) for t in range(10)]
    return spark.createDataFrame(hot + rest, "conv_id bigint, turn bigint, role string, text string")


def expected_prompts(rows):
    history, out = {}, {}
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        history[r["conv_id"]] = history.get(r["conv_id"], "") + shown(r["role"], r["text"])
        if r["role"] == "user":
            out[r["conv_id"], r["turn"]] = history[r["conv_id"]] + "<|im_start|>assistant\n"
    return out, history


@pytest.mark.parametrize("block", [1, 7, 64, 10_000])
def test_blocks_do_not_change_results(long_conversation, block):
    expected, texts = expected_prompts(long_conversation.collect())
    prompts = chat.turn_prompts(long_conversation, block_turns=block).collect()
    assert {(r["conv_id"], r["turn"]): r["prompt"] for r in prompts} == expected
    folded = chat.fold_text(long_conversation, block_turns=block).collect()
    assert {r["conv_id"]: r["text"] for r in folded} == texts
    spans = chat.prompt_spans(long_conversation, block_turns=block).collect()
    assert {(r["conv_id"], r["turn"]): r["prompt_chars"] for r in spans} == {k: len(v) for k, v in expected.items()}
    parts = chat.fold_text_parts(long_conversation, block_turns=block).orderBy("conv_id", "part").collect()
    joined = {}
    for r in parts:
        joined[r["conv_id"]] = joined.get(r["conv_id"], "") + r["text"]
    assert joined == texts


def test_clear_history(long_conversation):
    cleared = (F.col("turn") % 100 == 99) | (F.col("turn") == 3)
    rows = chat.after_clear(long_conversation, cleared, block_turns=16).groupBy("conv_id").count().collect()
    assert {r["conv_id"]: r["count"] for r in rows} == {c: 6 for c in range(1, 141)}


def test_row_places_follow_the_order(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 500).alias("k")).repartition(6)
    assert sorted(map(tuple, sampling.row_places(rows.orderBy("k"), "place").collect())) == [(i, i) for i in range(500)]
    assert sampling.row_places(rows.where("k < 0").orderBy("k")).count() == 0


def test_adapters_without_configuration_have_no_base(spark):
    paths = spark.createDataFrame([("o/a",), ("o/b",), ("o/c",)], "path string")
    configs = spark.createDataFrame([("o/a", '{"base_model_name_or_path": "m/x"}'), ("o/b", "{")], "dir string, value string")
    models = spark.createDataFrame([("models/x", "x")], "path string, name string")
    found = catalog.resolve_base(catalog.adapter_settings(paths, configs), models).select("path", "base_model", "resolved", "is_local")
    assert sorted(map(tuple, found.collect())) == [
        ("o/a", "m/x", "models/x", True), ("o/b", None, None, False), ("o/c", None, None, False)]


# ---- sampling -------------------------------------------------------------


def test_shuffle_is_a_permutation_independent_of_partitions(spark):
    ids = spark.range(1000)
    first = [r["id"] for r in sampling.seeded_shuffle(ids.repartition(3), "id").collect()]
    second = [r["id"] for r in sampling.seeded_shuffle(ids.repartition(17), "id").collect()]
    assert first == second and sorted(first) == list(range(1000)) and first != sorted(first)
    assert first != [r["id"] for r in sampling.seeded_shuffle(ids, "id", seed=7).collect()]


def test_large_sample_equals_top_k(spark, monkeypatch):
    ids = spark.range(5000)
    order = [r["id"] for r in sampling.seeded_shuffle(ids, "id").collect()]
    monkeypatch.setattr(sampling, "TOP_K_ROWS", 10)
    for digits in (1, 4):
        monkeypatch.setattr(sampling, "BUCKET_DIGITS", digits)
        for n in (11, 1234, 4999, 5000, 9000):
            rows = [r["id"] for r in sampling.seeded_sample(ids, "id", n).collect()]
            assert rows == order[:n]
            loose = [r["id"] for r in sampling.seeded_sample(ids, "id", n, ordered=False).collect()]
            assert sorted(loose) == sorted(rows)
        numbers = {r["id"]: r["number"] for r in sampling.seeded_numbers(ids, "id").collect()}
        assert [numbers[i] for i in order] == list(range(5000))


def test_ordered_numbers(spark, monkeypatch):
    rows = spark.range(2000).select(F.when(F.col("id") < 700, 1).otherwise(F.col("id")).alias("k"), "id")
    numbers = sampling.ordered_numbers(rows, "k", "id").orderBy("k", "id").collect()
    assert [r["number"] for r in numbers] == list(range(2000))
    monkeypatch.setattr(sampling, "TOP_K_ROWS", 10)
    assert sampling.limit_samples(rows, 900, "k", "id").count() == 900


def test_batch_plan(spark):
    plan = sampling.batch_plan(spark.range(21), "id", per_device=2, accumulation=2, max_steps=14).collect()
    steps = {}
    for r in plan:
        steps.setdefault(r["step"], []).append(r)
    # 21 rows in batches of 4 make 6 steps per epoch; the last one is short
    assert sorted(steps) == list(range(14))
    assert [len(steps[s]) for s in range(6)] == [4, 4, 4, 4, 4, 1]
    first = {r["id"] for r in plan if r["epoch"] == 0}
    assert first == set(range(21))
    order = lambda e: [r["id"] for r in sorted((r for r in plan if r["epoch"] == e), key=lambda r: (r["micro_batch"], r["slot"]))]
    assert order(0) != order(1)
    assert sampling.batch_plan(spark.range(0), "id").count() == 0
    assert sampling.log_interval(2000) == 100 and sampling.log_interval(10) == 1
    assert sampling.effective_batch() == 8 and sampling.cpu_limits(2, 1024) == (1, 512)


# ---- generation -----------------------------------------------------------


def test_stop_tokens(spark):
    assert one(spark, generate.stop_tokens(F.array(F.lit(1), F.lit(2)), F.lit(2), F.lit(3))) == [1, 2, 3]
    none = F.lit(None).cast("int")
    assert one(spark, generate.stop_tokens(F.lit(5), none, none, config_is_list=False)) == [5]
    assert one(spark, generate.stop_tokens_or_eos(F.array().cast("array<int>"), F.lit(9))) == [9]


def test_new_tokens_shorter_than_prompt(spark):
    assert one(spark, generate.new_tokens(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2)))) == []


def test_throughput_without_time(spark):
    assert one(spark, generate.tokens_per_second(F.lit(5), F.lit(0.0))) == 0.0


def test_model_is_loaded_once_per_task(spark, tmp_path):
    folder = str(tmp_path)

    def factory():
        import os
        import uuid

        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        return lambda prompts: [p.upper() for p in prompts]

    prompts = spark.range(100).select("id", F.concat(F.lit("p"), F.col("id")).alias("prompt")).repartition(4)
    rows = generate.generate_batch(prompts, factory).collect()
    assert {r["id"]: r["reply"] for r in rows} == {i: f"P{i}" for i in range(100)}
    assert all(r["elapsed"] >= 0 for r in rows)
    assert len(list(tmp_path.iterdir())) == 4


def test_start_of_template_and_null_roles(spark):
    from chatloom.operators import chat
    from chatloom.operators.render import ChatTemplate

    template = ChatTemplate({"user": ("[", "]"), "assistant": ("", "|")}, generation=">", start="<s>")
    turns = [("c", 0, None, "hi"), ("c", 1, "assistant", "yo"), ("c", 2, "user", "ok"), ("d", 5, "user", "x")]
    df = spark.createDataFrame(turns, "conv_id string, turn long, role string, text string")
    for size in (1, 256):
        folded = {r.conv_id: r.text for r in chat.fold_text(df, template=template, block_turns=size).collect()}
        assert folded == {"c": "<s>[hi]yo|[ok]", "d": "<s>[x]"}
        prompts = {(r.conv_id, r.turn): r.prompt for r in chat.turn_prompts(df, template=template, block_turns=size).collect()}
        assert prompts == {("c", 0): "<s>[hi]>", ("c", 2): "<s>[hi]yo|[ok]>", ("d", 5): "<s>[x]>"}
        spans = {(r.conv_id, r.turn): r.prompt_chars for r in chat.prompt_spans(df, template=template, block_turns=size).collect()}
        assert spans == {k: len(v) for k, v in prompts.items()}


def test_prompt_file_with_leading_line_feed(spark, write):
    from chatloom.sources.prompts import read_prompts

    assert [r.prompt for r in read_prompts(spark, write("a.json", '\n\t["one", "two"]')).orderBy("pos").collect()] == ["one", "two"]
    assert [r.prompt for r in read_prompts(spark, write("b.json", '\n {"k1": 1}')).collect()] == ["k1"]


def test_empty_folder_has_an_empty_catalogue(spark, write):
    import os

    from chatloom.sources.trees import scan_datasets

    folder = os.path.dirname(write("notes.bin", "x"))
    assert scan_datasets(spark, folder).count() == 0
