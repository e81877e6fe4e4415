import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from chatloom.session import build_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "8",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def write(tmp_path):
    """Write a file below a fresh folder and return its path."""

    def put(name: str, content, encoding="utf-8") -> str:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        data = content if isinstance(content, bytes) else content.encode(encoding)
        path.write_bytes(data)
        return str(path)

    return put


@pytest.fixture
def splits(spark):
    """Cut files into splits of a few bytes for the duration of a test."""
    keys = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for key, value in keys.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def turns(df):
    """Messages of all samples in file order as (role, content) lists."""
    rows = df.orderBy("path", "pos").collect()
    return [[(m["role"], m["content"]) for m in row["messages"]] for row in rows]


def pairs(df):
    return [tuple(content for _, content in sample) for sample in turns(df)]
