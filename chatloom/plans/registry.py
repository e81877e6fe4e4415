"""Query registry and shared pieces of SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..constants import WHITESPACE
from ..session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name."""

    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(prepare(spark), sf_dir)

        run.__name__, run.__doc__ = function.__name__, function.__doc__
        QUERIES[function.__name__] = run
        if sql is not None:
            ORACLES[function.__name__] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- SQL pieces -----------------------------------------------------------

NL = "chr(10)"
SQL_WHITESPACE = " || ".join(f"chr({ord(ch)})" for ch in WHITESPACE)


def sql_strip(text: str) -> str:
    return f"trim({text}, {SQL_WHITESPACE})"


def sql_segment(role: str, text: str) -> str:
    return (
        f"CASE WHEN {role} IN ('system', 'user', 'assistant') "
        f"THEN '<|im_start|>' || {role} || {NL} || {text} || '<|im_end|>' || {NL} ELSE '' END"
    )


SQL_GENERATION = f"'<|im_start|>assistant' || {NL}"


def sql_size(size: str) -> str:
    return (
        f"CASE WHEN {size} < 1024 THEN CAST({size} AS BIGINT) || ' B' "
        f"WHEN {size} < 1048576 THEN printf('%.1f KB', {size} / 1024.0::DOUBLE) "
        f"WHEN {size} < 1073741824 THEN printf('%.1f MB', {size} / 1048576.0::DOUBLE) "
        f"ELSE printf('%.1f GB', {size} / 1073741824.0::DOUBLE) END"
    )
