"""Folds over ordered rows: a shuffle by key, a sort in each partition, and a state that runs along the rows.

Nothing but the state of the current key is held, whatever the number of its rows; sorts spill.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Characters of results held before a task hands them on.
HELD_CHARS = 4 << 20


class Fold(Protocol):
    """The state of one key. ``take`` gets a row's values after the key, ``end`` is called after the last row."""

    def take(self, *values) -> Iterable[tuple]: ...

    def end(self) -> Iterable[tuple]: ...


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], Fold], results: T.StructType | str) -> DataFrame:
    """`keys` and `results` of every row that the folds give. Null keys are a key.

    The other columns of `rows` go to the fold in the order they have. The number of partitions is
    `spark.sql.shuffle.partitions`: results may be far larger than the rows, whose size would merge partitions.
    """
    results = T._parse_datatype_string(results) if isinstance(results, str) else results
    schema = T.StructType([rows.schema[k] for k in keys] + results.fields)
    count, width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(keys)
    others = [c for c in rows.columns if c not in keys]
    ordered = rows.select(*keys, *others).repartition(count, *keys).sortWithinPartitions(*keys, *order)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        key, fold, out, chars = None, None, [], 0

        def flush():
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                given = []
                if fold is None or row[:width] != key:
                    if fold is not None:
                        given += [key + r for r in fold.end()]
                    key, fold = row[:width], start()
                given += [key + r for r in fold.take(*row[width:])]
                for r in given:
                    out.append(r)
                    chars += 64 + sum(len(v) for v in r if isinstance(v, str))
                if chars > HELD_CHARS:
                    yield flush()
                    out, chars = [], 0
        if fold is not None:
            out += [key + r for r in fold.end()]
        if out:
            yield flush()

    return ordered.mapInArrow(run, schema)
