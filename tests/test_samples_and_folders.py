"""Samples settled on ids, listings by the folder source, and files that Spark hides."""

import os

import pytest
from conftest import pairs

from chatloom.functions.paths import file_name
from chatloom.sources import datasets, folders, samples, trees
from chatloom.sources.files import place, read_lines, sample_id
from pyspark.sql import functions as F


def lines(n, tag):
    return "".join(f'{{"question": "{tag}{i}", "answer": "a"}}\n' + "\n" * (i % 3) for i in range(n))


@pytest.fixture
def folder(write):
    for name in ("a.jsonl", "b.jsonl"):
        path = write(f"set/{name}", lines(40, name[0]))
    return os.path.dirname(path)


def ordered(df):
    return [m[0]["content"] for m in (r["messages"] for r in df.collect())]


def test_scan_ids_are_file_and_number(spark, folder, splits):
    records = place(read_lines(spark, folder, "*.jsonl")).where("value <> ''")
    named = {(r.sample_id, r.value) for r in samples.scan_ids(records).collect()}
    assert named == {(r.sample_id, r.value) for r in sample_id(records).collect()} and len(named) == 80


@pytest.mark.parametrize("n", [1, 7, 80, 500])
def test_sample_is_the_start_of_the_shuffle(spark, folder, n):
    whole = ordered(datasets.load_dataset(spark, folder))
    assert ordered(datasets.load_dataset(spark, folder, max_samples=n)) == whole[:n]
    assert sorted(whole) != whole and len(set(whole)) == 80


def test_sample_does_not_depend_on_splits(spark, folder, request):
    whole = ordered(datasets.load_dataset(spark, folder, max_samples=30))
    request.getfixturevalue("splits")
    assert ordered(datasets.load_dataset(spark, folder, max_samples=30)) == whole


def test_sample_of_arrays_and_csv(spark, write):
    array = write("x.json", "[" + ",".join(f'{{"instruction": "i{i}", "output": "o"}}' for i in range(30)) + "]")
    table = write("t/y.csv", "question,answer\n" + "".join(f"q{i},a\n" for i in range(30)))
    for path in (array, table):
        whole = ordered(datasets.load_dataset(spark, path))
        assert ordered(datasets.load_dataset(spark, path, max_samples=11)) == whole[:11] and len(whole) == 30


def test_sample_has_no_window_over_records(spark, folder, capsys):
    records = place(read_lines(spark, folder, "*.jsonl")).where("value <> ''")
    samples.sampled_records(records, 10).explain()
    plan = capsys.readouterr().out
    assert "Window" not in plan and "value" in plan


def test_places(spark, folder):
    records = place(read_lines(spark, folder, "*.jsonl")).where("value <> ''")
    found = samples.sampled_records(records, 25).collect()
    assert [r.place for r in found] == list(range(25))


def test_tree_listing(spark, write):
    for name, text in {"x.jsonl": "1", "_y.jsonl": "22", "empty.txt": "", "a/_b/c d%+é.csv": "333", ".hidden/z.txt": "4", "a/k=1/_m.txt": "5"}.items():
        root = write(f"tree/{name}", text)
    root = root[: root.index("/tree/") + 5]
    os.symlink(f"{root}/a", f"{root}/link")
    strip = lambda df: {r.path.removeprefix(f"file:{root}/"): r.length for r in df.collect()}
    real = {"x.jsonl": 1, "_y.jsonl": 2, "empty.txt": 0, "a/_b/c d%+é.csv": 3, "a/k=1/_m.txt": 1}
    assert strip(folders.list_tree(spark, root)) == real
    linked = {f"link{k[1:]}": v for k, v in real.items() if k.startswith("a/")}
    assert strip(folders.list_tree(spark, root, 3, once=False)) == real | linked
    assert strip(folders.list_tree(spark, root, 1)) == {k: v for k, v in real.items() if "/" not in k}
    assert folders.list_tree(spark, f"{root}/x.jsonl").count() == 1
    with pytest.raises(Exception, match="does not exist"):
        folders.list_tree(spark, f"{root}/none").count()


def test_hidden_files_are_read_whole_and_named(spark, write):
    for name in ("_a.jsonl", "b.jsonl", "_c/_d.jsonl"):
        path = write(f"data/{name}", lines(3, name.replace("/", "")))
    root = path[: path.index("/data/") + 5]
    listed = folders.list_tree(spark, root).withColumn("name", F.substring("path", len(f"file:{root}/") + 1, 1000))
    shown = folders.ShownFiles(spark, root, listed.where(folders.hidden_from_spark(F.col("name"))))
    rows = shown.restored(read_lines(spark, shown.paths, "*.jsonl", True)).where("value <> ''").collect()
    assert {r.path for r in rows} == {f"file:{root}/{n}" for n in ("_a.jsonl", "b.jsonl", "_c/_d.jsonl")} and len(rows) == 9


@pytest.mark.parametrize("names", [("_x.jsonl",), ("_x.jsonl", "y.jsonl"), ("_x.csv", "y.csv"), ("_x.txt", "y.txt")])
def test_loads_take_hidden_files(spark, write, names):
    kind = names[0].rsplit(".", 1)[1]
    for name in names:
        text = {"jsonl": lines(2, name), "csv": f"question,answer\n{name}0,a\n{name}1,a\n", "txt": f"{name}"}[kind]
        path = write(f"load/{name}", text)
    found = datasets.load_dataset(spark, os.path.dirname(path))
    expected = {name if kind == "txt" else f"{name}{i}" for name in names for i in range(1 if kind == "txt" else 2)}
    assert set(ordered(found)) == expected
    assert {r.n for r in found.select(file_name(F.col("path")).alias("n")).collect()} == set(names)


def test_models_in_hidden_and_linked_folders(spark, write):
    for name in ("_m", "n"):
        for file, text in {"config.json": '{"architectures": ["A"]}', "x.safetensors": "w", "tokenizer.json": "{}"}.items():
            path = write(f"models/{name}/{file}", text)
    root = path[: path.index("/models/") + 7]
    os.symlink(f"{root}/n", f"{root}/o")
    rows = {r.name: (r.valid, r.architecture) for r in trees.scan_models(spark, root).collect()}
    assert rows == {"_m": (True, "A"), "n": (True, "A")}
