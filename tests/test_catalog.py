import json

import pytest
from pyspark.sql import functions as F

from chatloom.operators import catalog
from chatloom.sources import trees
from chatloom.sources.trees import scan_adapters, scan_datasets, scan_models, validation_report


def by_name(df):
    return {r["name"]: r for r in df.collect()}


def test_dataset_catalog(spark, write):
    write("d/good.jsonl", '{"question":"q","answer":"a"}\n\n{"question":"r"}\n')
    write("d/bad.jsonl", '{"question":"q","answer":"a"}\n{bad\n\n{"question":"r"}\n')
    write("d/odd.jsonl", '{"x":1,"y":2}\n')
    write("d/array.json", '[{"instruction":"i","output":"o"},{"x":1}]')
    write("d/empty_array.json", "[]")
    write("d/object.json", '{"a":1}')
    write("d/number.json", "3")
    write("d/scalars.json", "[1,2]")
    write("d/unknown.json", '[{"b":1,"a":2}]')
    write("d/broken.json", '[{"a":1}')
    write("d/blank.txt", " \n\n ")
    write("d/zero.jsonl", "")
    write("d/text.txt", "p1\n\np2\n")
    write("d/long.txt", "x" * 150 + "\n" + "y" * 100)
    write("d/latin.txt", b"\xff\x41")
    write("d/latin.jsonl", b'{"question":"\xff"}\n')
    write("d/table.csv", "Question,Reply\nq,a\n\nr,b\n")
    write("d/plain.csv", "a,b\n1,2\n")
    write("d/header.csv", "question,answer\n")
    write("d/s1/s2/deep.TXT", "deep")
    write("d/s1/s2/s3/deeper.txt", "too deep")
    write("d/README.md", "no")
    path = write("d/other.parquet", "no")
    for whole in (10**9, 0):
        rows = by_name(scan_datasets(spark, path.rsplit("/", 1)[0], whole_file_bytes=whole))

        def verdict(name):
            r = rows[name]
            return r["format"], r["valid"], r["sample_count"], r["fields"], r["errors"], r["warnings"]

        assert verdict("good.jsonl") == ("jsonl", True, 2, ["question", "answer"], [], [])
        assert verdict("bad.jsonl") == ("jsonl", False, 3, ["question", "answer"], ["bad_json_lines:1/3"], [])
        assert verdict("odd.jsonl") == ("jsonl", True, 1, ["x", "y"], [], ["unknown_fields:x,y"])
        assert verdict("array.json") == ("alpaca", True, 2, ["instruction", "output"], [], [])
        if whole:
            assert verdict("empty_array.json") == ("json", False, 0, [], ["empty_array"], [])
            assert verdict("object.json") == ("json", False, 0, [], [], ["object_not_array"])
            assert verdict("number.json") == ("json", False, 0, [], ["unexpected_json"], [])
        assert verdict("scalars.json") == ("json", False, 2, [], [], ["elements_not_objects"])
        assert verdict("unknown.json") == ("json", False, 1, ["b", "a"], [], ["unknown_fields:b,a"])
        assert verdict("broken.json")[1:3] == (False, 0) or not whole
        assert verdict("blank.txt") == ("txt", False, 0, [], ["empty_file"], [])
        assert verdict("zero.jsonl") == ("jsonl", False, 0, [], ["empty_file"], [])
        assert verdict("text.txt") == ("txt", True, 2, [], [], [])
        assert verdict("long.txt") == ("txt", True, 1, [], [], ["single_paragraph"])
        preview = json.loads(rows["long.txt"]["first_sample"])["text"]
        assert preview == "x" * 150 + "\\n" + "y" * 49 + "..."
        assert verdict("latin.txt") == ("txt", False, 0, [], ["not_utf8"], [])
        assert verdict("latin.jsonl") == ("jsonl", False, 0, [], ["not_utf8"], [])
        assert verdict("table.csv") == ("csv", True, 2, ["Question", "Reply"], [], [])
        assert json.loads(rows["table.csv"]["first_sample"]) == {"Question": "q", "Reply": "a"}
        assert verdict("plain.csv") == ("csv", False, 1, ["a", "b"], [], ["unknown_columns:a,b"])
        assert verdict("header.csv") == ("csv", False, 0, [], ["csv_needs_header_and_row"], [])
        assert verdict("s1/s2/deep.TXT") == ("txt", True, 1, [], [], ["single_paragraph"])
        assert "s1/s2/s3/deeper.txt" not in rows and "README.md" not in rows and "other.parquet" not in rows
        assert rows["plain.csv"]["size"] == "8 B"


@pytest.fixture
def models(write):
    tokenizers = {"tokenizer_config.json": "{}"}
    folders = {
        "m/valid": {"config.json": '{"architectures":["A"],"model_type":"t"}', "model.safetensors": "w", **tokenizers},
        "m/index": {"config.json": '{"model_type":"t"}', "model.safetensors.index.json": "{}", "tokenizer.json": "{}"},
        "m/bad": {"config.json": "{bad", "pytorch_model.bin": "w", **tokenizers},
        "m/shards": {"config.json": '{"architectures":"S"}', "a-1.safetensors": "w", "a-2.safetensors": "w", **tokenizers},
        "m/empty_list": {"config.json": '{"architectures":[],"model_type":"t"}', "x.pt": "w", **tokenizers},
        "m/sub/a/b/deep": {"config.json": "{}", "m.ckpt": "w", **tokenizers},
        "m/sub/a/b/c/too_deep": {"config.json": "{}"},
    }
    for folder, files in folders.items():
        for name, text in files.items():
            path = write(f"{folder}/{name}", text)
    write("m/loose.txt", "not in a folder")
    return path.split("/m/")[0] + "/m"


def test_model_catalog(spark, models):
    rows = by_name(scan_models(spark, models, list_all=True))
    assert set(rows) == {"valid", "index", "bad", "shards", "empty_list", "sub/a/b/deep"}
    valid = rows["valid"]
    assert (valid["valid"], valid["architecture"], valid["model_type"], valid["required_ok"]) == (True, "A", "t", True)
    assert valid["files"] == ["config.json", "model.safetensors", "tokenizer_config.json"]
    assert valid["errors"] == valid["warnings"] == valid["missing"] == []
    index = rows["index"]
    assert (index["valid"], index["architecture"], index["missing"]) == (False, "t", ["weights"])
    assert index["warnings"] == ["missing_tokenizer_config"] and index["errors"] == ["missing_weights"]
    assert rows["bad"]["valid"] and rows["bad"]["errors"] == ["bad_config_json"]
    assert rows["shards"]["architecture"] == "S" and rows["shards"]["warnings"] == ["shards_without_index"]
    assert rows["empty_list"]["errors"] == ["unreadable_config"] and rows["empty_list"]["model_type"] == "Unknown"
    report = catalog.report_rows(scan_models(spark, models)).where("name = 'bad'").first()
    assert report["status"] == "OK" and report["errors"] == "bad_config_json"


def test_model_root_counts_with_a_configuration(spark, write):
    path = write("root/config.json", "{}")
    rows = by_name(scan_models(spark, path.rsplit("/", 1)[0]))
    assert rows["root"]["missing"] == ["weights", "tokenizer"]


@pytest.fixture
def adapters(write):
    settings = {"base_model_name_or_path": "org/valid", "r": 16, "lora_alpha": 32, "target_modules": ["q"], "task_type": "T"}
    path = write("o/one/adapter_config.json", json.dumps(settings))
    write("o/one/tokenizer.json", "{}")
    write("o/one/checkpoint/w.bin", "x" * 2000)
    write("o/two/adapter_config.json", '{"target_modules":"all-linear"}')
    write("o/three/adapter_config.json", "{bad")
    write("o/four/w.bin", "no adapter")
    return path.split("/o/")[0] + "/o"


def test_adapter_catalog(spark, adapters):
    rows = by_name(scan_adapters(spark, adapters))
    assert set(rows) == {"one", "two", "three"}
    one = rows["one"]
    assert (one["base_model"], one["rank"], one["lora_alpha"], one["target_modules"]) == ("org/valid", 16, 32.0, ["q"])
    assert one["has_tokenizer"] and one["size"] == "2.1 KB"
    assert rows["two"]["target_modules"] == ["all-linear"] and rows["two"]["base_model"] == ""
    assert rows["three"]["base_model"] is None and not rows["three"]["has_tokenizer"]
    assert scan_adapters(spark, adapters, details=False).columns == ["name", "path"]


def test_adapter_base(spark):
    adapters = spark.createDataFrame(
        [("a", "models/x"), ("b", "org/x"), ("c", "hub/unknown"), ("d", ""), ("e", None), ("f", "x")], "path string, base_model string"
    )
    models = spark.createDataFrame([("models/x", "x"), ("other/x", "x")], "path string, name string")
    rows = {r["path"]: (r["resolved"], r["is_local"]) for r in catalog.resolve_base(adapters, models).collect()}
    assert rows == {
        "a": ("models/x", True), "b": ("models/x", True), "c": ("hub/unknown", False),
        "d": (None, False), "e": (None, False), "f": ("models/x", True),
    }


def test_report_totals(spark, models, write):
    path = write("data/a.jsonl", '{"question":"q"}\n{bad\n')
    rows = {r["section"]: (r["valid"], r["total"]) for r in validation_report(spark, models, path.rsplit("/", 1)[0]).collect()}
    assert rows == {"models": (5, 6), "datasets": (0, 1)}


def test_no_datasets(spark, tmp_path):
    (tmp_path / "a.parquet").write_text("x")
    found = trees.scan_datasets(spark, str(tmp_path))
    assert found.count() == 0 and "sample_count" in found.columns


def test_folders_are_judged_once_each_and_not_by_file(spark):
    numbered = spark.range(600).select(
        F.concat(F.lit("/m/models/"), F.col("id") % 40, F.lit("/f"), F.col("id"), F.lit(".bin")).alias("path"), F.col("id").alias("length"))
    odd = spark.createDataFrame([("/m/models/.git/config.json", 1), ("/m/models/config.json", 2), (None, 3)], "path string, length bigint")
    configs = spark.range(3).select(F.concat(F.lit("/m/models/"), "id").alias("dir"), F.lit('{"model_type": "t"}').alias("value"))
    found = catalog.model_catalog(numbered.union(odd), configs, "/m/models", list_all=False)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 1 and plan.index("RLIKE") < plan.index("Aggregate [dir")  # above the rows per folder
    rows = {r["name"]: r for r in found.collect()}
    assert set(rows) == {"models", *map(str, range(40))}
    assert rows["7"]["n_files"] == 15 and rows["7"]["files"] == sorted(f"f{i}.bin" for i in range(7, 600, 40))[:8]
    assert [rows[n]["model_type"] for n in ("1", "5")] == ["t", "Unknown"]


def test_report_rows_in_any_order(spark):
    rows = spark.createDataFrame([("b", True, ["x"]), ("a", False, [])], "name string, valid boolean, errors array<string>")
    assert [r["name"] for r in catalog.report_rows(rows).collect()] == ["a", "b"]
    assert "Sort" not in catalog.report_rows(rows, ordered=False)._jdf.queryExecution().optimizedPlan().toString()
