"""Tables written out as files."""

import os

from chatloom.plans import staging
from chatloom.sources import datasets
from chatloom.streaming.ingest import stream_lines


def staged(spark, path):
    found = datasets.read_text(spark, f"{path}/*", directory=True)
    found = found.select(staging.path_key(found["path"], "k").alias("k"), found["messages"][0]["content"].alias("text"))
    return sorted(map(tuple, found.collect()), key=str)


def test_text_files_share_folders(spark):
    rows = [(k, f"text {k}\n\nmore") for k in range(-1, 300)] + [(7, "again"), (None, "no key"), (301, ""), (302, None)]
    texts = spark.createDataFrame(rows, "k bigint, value string").repartition(3)
    path = staging.stage_text_files(texts, "k", "test-files")
    folders = [f for f in os.listdir(path.removeprefix("file:")) if not f.startswith((".", "_"))]
    assert len(folders) <= 3  # not one per key, all of which a listing would open
    assert staged(spark, path) == sorted(rows[:-2], key=str)
    assert not [n for f in folders for n in os.listdir(f"{path.removeprefix('file:')}/{f}") if not n.endswith(".txt")]


def test_text_files_where_only_spark_can_open_the_folder(spark, monkeypatch):
    monkeypatch.setattr(staging, "can_open", lambda path: False)
    texts = spark.createDataFrame([(1, "a"), (-2, "b")], "k bigint, value string")
    assert staged(spark, staging.stage_text_files(texts, "k", "test-files")) == [(-2, "b"), (1, "a")]


def test_text_files_of_no_rows(spark):
    path = staging.stage_text_files(spark.createDataFrame([], "k bigint, value string"), "k", "test-files")
    assert stream_lines(spark, f"{path}/*").isStreaming


def test_listings_have_few_tasks(spark):
    assert int(spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")) == 8 * spark.sparkContext.defaultParallelism
