"""Generation with a ledger of replies."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from chatloom.operators.generate import generate_batch, generate_missing, open_replies
from chatloom.session import shared_path


@pytest.fixture
def calls(tmp_path):
    """A model that notes every prompt it is given, and fails on one."""
    notes = str(tmp_path / "calls")
    os.mkdir(notes)

    def factory(bad=None, mark=""):
        def load():
            def model(prompts, **settings):
                for p in prompts:
                    if p == bad:
                        raise RuntimeError("model failed")
                    with open(f"{notes}/{uuid.uuid4().hex}", "w") as out:
                        out.write(p)
                return [f"{mark}{p}" for p in prompts]
            return model
        return load

    def noted():
        return sorted(open(f"{notes}/{n}").read() for n in os.listdir(notes))

    return factory, noted


def test_rerun_asks_for_missing_prompts_only(spark, calls):
    factory, noted = calls
    prompts = spark.range(60).select("id", F.concat(F.lit("p"), F.col("id") % 40).alias("prompt"))
    ledger = shared_path(spark, "test-replies")
    with pytest.raises(Exception, match="model failed"):
        generate_missing(prompts, factory("p7"), ledger, commit_rows=5)
    held = {r.reply for r in open_replies(spark, ledger).collect()}
    assert 0 < len(held) < 40
    before = noted()
    found = generate_missing(prompts, factory(), ledger, commit_rows=5)
    assert {r.id: r.reply for r in found.collect()} == {i: f"p{i % 40}" for i in range(60)}
    asked = list(noted())
    for p in before:
        asked.remove(p)
    assert sorted(asked) == sorted({f"p{i}" for i in range(40)} - held)
    generate_missing(prompts, factory("p7"), ledger).collect()  # nothing is asked again


def test_settings_models_and_keys_tell_requests_apart(spark, calls):
    factory, noted = calls
    ledger = shared_path(spark, "test-replies")
    rows = [("a", 1, 0), ("a", 1, 1), ("a", 2, 0), ("a", None, 0), (None, 1, 0), ("", 1, 0), ("a", 1, 0)]
    df = spark.createDataFrame(rows, "prompt string, top_k int, `dotted.name` int").withColumnRenamed("dotted.name", "n.o")
    found = generate_missing(df, factory(), ledger, settings=("top_k",))
    assert found.columns == ["prompt", "top_k", "n.o", "reply", "new_tokens", "elapsed"]
    assert sorted((r.prompt, r.reply) for r in found.collect() if r.prompt is not None) == [("", "")] + [("a", "a")] * 5
    assert noted() == ["", "a", "a", "a"]
    assert [r.reply for r in found.where("prompt is null").collect()] == [None]
    generate_missing(df, factory(mark="m"), ledger, settings=("top_k",), model="m")
    assert len(noted()) == 8
    generate_missing(df.withColumnRenamed("n.o", "n"), factory(), ledger, settings=("top_k",), keys=("n",))
    assert len(noted()) == 13
    assert generate_missing(df.limit(0), factory(), ledger).count() == 0


def test_long_prompts_come_in_several_calls(spark):
    def factory():
        # a reply says what its call was given
        return lambda prompts, top_k: [(f" {len(prompts)} {sum(map(len, prompts))} {k} ", n) for n, k in enumerate(top_k)]

    rows = spark.range(40, numPartitions=1).select(
        "id", F.repeat(F.lit("x"), F.when(F.col("id") == 5, 6_000_000).otherwise(500_000)).alias("prompt"),
        (F.col("id") * 2).cast("int").alias("top_k"), F.array("id").alias("listed"), F.lit(None).cast("date").alias("none"))
    found = generate_batch(rows, factory, settings=("top_k",)).drop("prompt").orderBy("id").collect()
    assert [(r["id"], r["listed"], r["none"]) for r in found] == [(i, [i], None) for i in range(40)]
    given = [[int(v) for v in r["reply"].split()] for r in found]
    assert all(size <= 4 << 20 or n == 1 for n, size, _ in given) and max(n for n, _, _ in given) == 8
    assert [k for _, _, k in given] == [2 * i for i in range(40)]
    assert [r["new_tokens"] for r in found[:7]] == [0, 1, 2, 3, 4, 0, 0]
    assert generate_batch(rows.where("id < 0"), factory, settings=("top_k",)).count() == 0
