"""Inputs and outputs of text generation as tables, and hooks for user models and tokenizers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import GENERATION_DEFAULTS, MAX_SEQ_LENGTH
from ..session import shared_path, stored

#: Requests generated between two commits to a ledger.
COMMIT_ROWS = 100_000

#: Bytes of prompts that a model gets in one call, unless one prompt has more.
CALL_BYTES = 4 << 20


def falsy_default(*choices: Column, default) -> Column:
    """First choice that is neither null nor zero, else the default."""
    zero = F.lit(0)
    return F.coalesce(*[F.nullif(c, zero.cast("double")) for c in choices], F.lit(default))


def pad_token(pad: Column, eos: Column) -> Column:
    """Padding id, or the end id where it is missing or zero."""
    return F.when(pad.isNotNull() & (pad != 0), pad).otherwise(eos)


def resolve_settings(df: DataFrame, defaults: Mapping = GENERATION_DEFAULTS, prefix: str = "") -> DataFrame:
    """Fill every generation setting: the row's own value where the column exists and is set."""
    for name, value in defaults.items():
        column = f"{prefix}{name}"
        chosen = F.coalesce(F.col(column), F.lit(value)) if column in df.columns else F.lit(value)
        df = df.withColumn(column, chosen)
    return df


def _as_list(ids: Column, is_list: bool) -> Column:
    empty = F.array().cast("array<int>")
    if is_list:
        return F.coalesce(ids.cast("array<int>"), empty)
    return F.when(ids.isNotNull(), F.array(ids.cast("int"))).otherwise(empty)


def stop_tokens(config_ids: Column, eos: Column, eot: Column, config_is_list: bool = True) -> Column:
    """Distinct end-of-text ids in order: model configuration, tokenizer end, end of turn."""
    return F.array_distinct(F.concat(_as_list(config_ids, config_is_list), _as_list(eos, False), _as_list(eot, False)))


def stop_tokens_or_eos(stops: Column, eos: Column) -> Column:
    return F.when(F.size(stops) > 0, stops).otherwise(F.array(eos.cast("int")))


def new_tokens(output_ids: Column, input_ids: Column) -> Column:
    """Ids generated after the prompt."""
    start = F.size(input_ids)
    return F.slice(output_ids, start + 1, F.greatest(F.size(output_ids) - start, F.lit(0)))


def truncate_tokens(tokens: Column, length: int = MAX_SEQ_LENGTH) -> Column:
    return F.slice(tokens, 1, length)


def whitespace_tokens(text: Column) -> Column:
    """Stand-in tokens where no tokenizer is given."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def tokens_per_second(tokens: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, tokens / seconds).otherwise(F.lit(0.0))


def throughput(df: DataFrame, *keys: str, tokens: str = "new_tokens", seconds: str = "elapsed") -> DataFrame:
    """``requests, new_tokens, elapsed, tokens_per_second`` per group."""
    total = df.groupBy(*keys).agg(
        F.count("*").alias("requests"), F.sum(tokens).alias("new_tokens"), F.sum(seconds).alias("elapsed")
    )
    return total.withColumn("tokens_per_second", tokens_per_second(F.col("new_tokens"), F.col("elapsed")))


def tokenize_with(factory: Callable[[], Callable], text: Column) -> Column:
    """Token ids by a user tokenizer; the factory runs once per Python worker task."""

    def encode(batches):
        encoder = factory()
        for texts in batches:
            yield texts.map(lambda t: list(encoder(t)) if t is not None else None)

    # the iterator form of a pandas UDF is recognised by its type hints
    import pandas as pd

    encode.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(encode, T.ArrayType(T.IntegerType()))(text)


def _calls(batch, prompt: str):
    """A batch in consecutive slices of about CALL_BYTES of prompts."""
    import pyarrow.compute as pc

    begin, held = 0, 0
    for row, size in enumerate(pc.fill_null(pc.binary_length(batch.column(prompt)), 0).to_pylist()):
        if row > begin and held + size > CALL_BYTES:
            yield batch.slice(begin, row - begin)
            begin, held = row, 0
        held += size
    if batch.num_rows:
        yield batch.slice(begin)


def generate_batch(
    df: DataFrame, factory: Callable[[], Callable], prompt: str = "prompt", settings: tuple[str, ...] = (), profile=None
) -> DataFrame:
    """Add ``reply, new_tokens, elapsed``: a call of the user's model per Arrow batch of prompts, or per CALL_BYTES of one.

    ``factory`` loads the model once per task and returns ``generate(prompts, **settings)``. It is given
    a list of prompts and, per setting, a list as long, and gives one reply or (reply, number of new
    tokens) per prompt. ``elapsed`` is a prompt's share of its call. Rows keep their key columns, so the
    order of the prompts never depends on the order of rows. ``profile`` is a ResourceProfile for the tasks
    that run the model, such as one that asks for GPUs.
    """
    schema = T.StructType(df.schema.fields + [
        T.StructField("reply", T.StringType()),
        T.StructField("new_tokens", T.LongType()),
        T.StructField("elapsed", T.DoubleType()),
    ])

    def run(batches):
        import pyarrow as pa

        model = None
        # only prompts and settings become Python objects, a call's at a time; all columns pass through as they are
        for batch in (part for whole in batches for part in _calls(whole, prompt)):
            model = model or factory()
            given = {s: batch.column(s).to_pandas(date_as_object=True).tolist() for s in settings}
            begin = time.perf_counter()
            results = list(model(batch.column(prompt).to_pylist(), **given))
            if len(results) != batch.num_rows:
                raise ValueError(f"{len(results)} replies to {batch.num_rows} prompts")
            results = [r if isinstance(r, tuple) else (r, len(r.split())) for r in results]
            share = (time.perf_counter() - begin) / batch.num_rows
            replies, counts = zip(*results)
            added = [
                pa.array([r.strip() for r in replies], batch.column(prompt).type), pa.array(counts, pa.int64()),
                pa.array([share] * batch.num_rows, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema.names)

    return df.mapInArrow(run, schema, profile=profile)


REPLY_SCHEMA = "request string, reply string, new_tokens bigint, elapsed double"


def request_key(model: str, prompt: Column, *more: Column) -> Column:
    """Digest of what a reply depends on."""
    return F.sha2(F.to_json(F.array(F.lit(model), prompt, *[c.cast("string") for c in more])), 256)


def open_replies(spark: SparkSession, ledger: str) -> DataFrame:
    """The replies a ledger holds; the table is made if there is none."""
    spark.createDataFrame([], REPLY_SCHEMA).write.mode("ignore").parquet(ledger)
    return spark.read.schema(REPLY_SCHEMA).parquet(ledger)


def generate_missing(
    df: DataFrame, factory: Callable[[], Callable], ledger: str, prompt: str = "prompt", settings: tuple[str, ...] = (),
    model: str = "", keys: tuple[str, ...] = (), commit_rows: int = COMMIT_ROWS, profile=None,
) -> DataFrame:
    """``generate_batch`` that calls the model only for requests whose reply the ledger does not hold yet.

    A request is the model's name, the prompt, the settings and the columns `keys` (say, the number of a sample);
    equal requests get one reply. Requests are dealt into parts of about `commit_rows`, and every part is appended to
    the ledger when it is done: after a failure a rerun asks for the requests of unfinished parts alone. Rows without
    a prompt get no reply. The column name ``_request`` is taken.
    """
    spark = df.sparkSession
    asked = df.withColumn("_request", request_key(model, F.col(prompt), *[F.col(c) for c in (*settings, *keys)]))
    known = open_replies(spark, ledger).select(F.col("request").alias("_request"))
    todo = asked.where(F.col(prompt).isNotNull()).select("_request", prompt, *settings).join(known, "_request", "left_anti")
    todo = stored(todo.dropDuplicates(["_request"]), "requests")
    parts = -(-todo.count() // commit_rows)
    if parts > 1:
        dealt = shared_path(spark, "request-parts")
        part = F.pmod(F.xxhash64("_request"), F.lit(parts)).alias("_part")
        # all tasks share in every part, so that a part is generated by the whole cluster
        todo.select("*", part).write.partitionBy("_part").parquet(dealt)
        dealt = spark.read.parquet(dealt)
    for number in range(parts):
        rows = dealt.where(F.col("_part") == number).drop("_part") if parts > 1 else todo
        found = generate_batch(rows, factory, prompt, settings, profile)
        found.select(F.col("_request").alias("request"), "reply", "new_tokens", "elapsed").write.mode("append").parquet(ledger)
    # runs at the same time may have asked for the same; one reply is taken
    held = open_replies(spark, ledger).groupBy(F.col("request").alias("_request")).agg(
        F.min(F.struct("reply", "new_tokens", "elapsed")).alias("_held"))
    out = [F.col(f"`{c}`") for c in df.columns] + [F.col(f"_held.{c}").alias(c) for c in ("reply", "new_tokens", "elapsed")]
    return asked.join(held, "_request", "left").select(*out)
