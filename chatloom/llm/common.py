"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_path

#: A word, as Java and DuckDB spell it: bytes.split() of Python cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Columns that operators on documents know by name.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def with_plain_names(operator):
    """An operator on documents that returns their columns, safe from names of further columns.

    Further columns go in as `extra_0`, `extra_1`, ..., so none can clash with a helper column, and come out
    under their own names, whatever these are (dots, leading underscores, names of helpers).
    """

    @wraps(operator)
    def run(docs: DataFrame, *args, **settings) -> DataFrame:
        names = docs.columns
        plain = [name if name in OWN else f"extra_{i}" for i, name in enumerate(names)]
        return operator(docs.toDF(*plain), *args, **settings).select(*plain).toDF(*names)

    return run


def schema(*fields: tuple[str, object]) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "binary": T.BinaryType(),
             "double": T.DoubleType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(name, kinds.get(kind, kind) if isinstance(kind, str) else kind) for name, kind in fields])


def texts_of(batch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column of an Arrow batch; null counts as empty."""
    import pyarrow as pa

    column = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [value or b"" for value in column.cast(kind).to_pylist()]


def split_hash(*columns, seed: int = 0):
    """A number from 0 to 2^31 - 1 that spreads rows evenly; null columns are allowed."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 31))


def crc32_sql(text: str) -> str:
    """crc32 of a text's UTF-8 bytes in DuckDB's SQL, which has no such function: the remainder bit by bit."""
    digit = lambda at: f"instr('0123456789ABCDEF', substring(hex({text}), {at}, 1)) - 1"
    codes = f"list_transform(range(1, strlen({text}) + 1), lambda i: 16 * ({digit('2 * i - 1')}) + {digit('2 * i')})"
    byte = "list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce([4294967295] || {codes}, lambda c, b: {byte}), 4294967295)"
