"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest
from conftest import SF

from __spark_entry__ import entry, oracle_sql, queries
from check import compare


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, connection, name):
    message, _, good = compare(spark, connection, name, SF)
    assert good, message


def test_entry(spark):
    assert entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(oracle_sql()) <= set(queries())
