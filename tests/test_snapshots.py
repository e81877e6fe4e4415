"""Catalogues brought up to date by a ledger."""

import os

import pytest
from pyspark.sql import functions as F

from chatloom.session import shared_path
from chatloom.sources import snapshots, trees
from chatloom.sources.csvfiles import read_rows
from chatloom.sources.files import Chosen, list_files, read_lines

FILES = {
    "a.jsonl": '{"question": "q", "answer": "a"}\n', "_b.jsonl": '{"question": "q", "answer": "a"}\n' * 3, "c.json": '[{"instruction": "i", "output": "o"}]',
    "d e/f.csv": "question,answer\nq,a\nr,b\n", "d e/g.txt": "one\n\ntwo", "h.txt": "", "100%.txt": "x",
}


@pytest.fixture
def tree(write):
    for name, text in FILES.items():
        path = write(f"tree/{name}", text)
    return path[: path.index("/tree/") + 5]


def rows(df):
    return {r["name"]: r for r in df.collect()}


def plain(found):
    return {k: {x: v for x, v in r.asDict().items() if x != "checked"} for k, r in found.items()}


def test_unchanged_files_keep_their_verdict(spark, tree):
    ledger = shared_path(spark, "test-ledger")
    first = rows(snapshots.update_datasets(spark, tree, ledger))
    assert set(first) == set(FILES) and all(r["checked"] for r in first.values())
    assert plain(first) == plain(rows(trees.scan_datasets(spark, tree)))
    second = rows(snapshots.update_datasets(spark, tree, ledger))
    assert plain(second) == plain(first) and not any(r["checked"] for r in second.values())
    third = rows(snapshots.update_datasets(spark, tree, ledger, version=2))
    assert plain(third) == plain(first) and all(r["checked"] for r in third.values())


def test_only_changed_files_are_opened(spark, tree, write):
    ledger = shared_path(spark, "test-ledger")
    snapshots.update_datasets(spark, tree, ledger).collect()
    # other content in the same length and time: a file that is opened would show it
    times = os.stat(f"{tree}/a.jsonl")
    write("tree/a.jsonl", "x" * times.st_size)
    os.utime(f"{tree}/a.jsonl", ns=(times.st_atime_ns, times.st_mtime_ns))
    write("tree/_b.jsonl", "not json\n")
    write("tree/new.csv", "question,answer\nq,a\n")
    os.remove(f"{tree}/c.json")
    found = rows(snapshots.update_datasets(spark, tree, ledger))
    assert set(found) == (set(FILES) | {"new.csv"}) - {"c.json"}
    assert {k for k, r in found.items() if r["checked"]} == {"_b.jsonl", "new.csv"}
    assert found["a.jsonl"]["valid"] and not found["_b.jsonl"]["valid"] and found["new.csv"]["sample_count"] == 1


def files_read(df):
    """Files that the scan of a plan without shuffles chose."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().apply("numFiles").value()


def test_index_leaves_other_files_out(spark, tree):
    wanted = list_files(spark, tree).where(F.col("path").rlike("[fg][.]|100%"))
    some = read_lines(spark, Chosen([tree], wanted), None, True)
    names = {os.path.basename(r.path) for r in some.select("path").distinct().collect()}
    assert names == {"f.csv", "g.txt", "100%.txt"}
    assert files_read(some) == 3 and files_read(read_lines(spark, tree, None, True)) == 5  # shown and not empty


def test_empty_folder(spark, tmp_path):
    assert snapshots.update_datasets(spark, str(tmp_path), shared_path(spark, "test-ledger")).count() == 0


def test_long_header_of_one_file(spark, write):
    header = '"' + "\n".join(f"h{i}" for i in range(40)) + '",answer'
    path = write("long/x.csv", f"{header}\nq,a\n")
    found = read_rows(spark, os.path.dirname(path)).collect()
    assert [list(r["cells"])[:2] for r in found] == [["q", "a"]] and found[0]["header"][1] == "answer"
