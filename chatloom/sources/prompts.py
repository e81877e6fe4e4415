"""Prompt lists for batch inference: ``path, pos, prompt``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import JSON_SPACE, QUESTION_KEYS
from ..functions.jsontext import first_truthy, json_keys, parse_record
from ..functions.text import strip
from .arrays import read_json_array
from .datasets import read_json_records
from .files import position, read_whole
from .textfiles import read_nonblank_lines

NARROW_KEYS = ("question", "prompt")


def prompts_from_records(df: DataFrame, value: str = "value", keys=QUESTION_KEYS, stripped: bool = True) -> DataFrame:
    """First truthy key of each JSON object; records without one are left out."""
    prompt = first_truthy(keys, value)
    prompts = parse_record(df, value).withColumn("prompt", strip(prompt) if stripped else prompt)
    failure = F.raise_error(F.concat(F.lit("bad record: "), F.left(value, F.lit(200)))).cast("string")
    prompts = prompts.withColumn("prompt", F.when(F.col("record").isNull(), failure).otherwise(F.col("prompt")))
    return prompts.where(F.col("prompt").isNotNull()).drop("record", "is_json", value)


def read_prompts_jsonl(
    spark: SparkSession, path, glob=None, keys=QUESTION_KEYS, stripped: bool = True
) -> DataFrame:
    return prompts_from_records(read_json_records(spark, path, "lines", glob), keys=keys, stripped=stripped)


def read_prompts_json(
    spark: SparkSession, path, glob=None, keys=QUESTION_KEYS, narrow: bool = False
) -> DataFrame:
    """Array of strings and objects, or an object whose keys are the prompts.

    Strings are stripped and kept even when empty. The narrow form leaves them as they are
    and keeps an empty prompt for objects without a key.
    """
    elements = read_json_array(spark, path, glob, typed=True, skip_others=True)
    elements = elements.withColumn("is_string", F.startswith("value", F.lit('"')))
    string = F.try_parse_json(F.col("value")).try_cast("string")
    if narrow:
        named = F.when(F.array_contains(json_keys(F.col("value")), "question"), F.col("record.question"))
        picked = F.coalesce(named.otherwise(F.col("record.prompt")), F.lit(""))
    else:
        string, picked = strip(string), strip(first_truthy(keys))
    chosen = F.when(F.col("is_string"), string).when(F.col("record").isNotNull(), picked)
    listed = parse_record(elements).select("path", "pos", chosen.alias("prompt"))
    listed = listed.where(F.col("prompt").isNotNull())
    if narrow:
        return listed
    files = read_whole(spark, path, glob).where(F.startswith(F.ltrim("value", F.lit(JSON_SPACE)), F.lit("{")))
    by_key = files.select("path", F.posexplode(json_keys(F.col("value"))).alias("row", "prompt"))
    return listed.unionByName(by_key.select("path", position(0, F.col("row")).alias("pos"), "prompt"))


def read_prompt_lines(spark: SparkSession, path, glob=None) -> DataFrame:
    """Every non-blank line, stripped; a CSV file is not parsed, so its header is a prompt too."""
    return read_nonblank_lines(spark, path, glob).withColumnRenamed("value", "prompt")


def read_prompts(spark: SparkSession, path: str, narrow: bool = False) -> DataFrame:
    """Prompts of a file by its extension; fails when there is none."""
    keys = NARROW_KEYS if narrow else QUESTION_KEYS
    kind = path.rsplit(".", 1)[-1]
    if kind == "jsonl":
        prompts = read_prompts_jsonl(spark, path, keys=keys, stripped=not narrow)
    elif kind == "json":
        prompts = read_prompts_json(spark, path, keys=keys, narrow=narrow)
    elif kind in ("txt", "csv"):
        prompts = read_prompt_lines(spark, path)
    else:
        raise ValueError(f"no prompt reader for {path}")
    return require_rows(prompts, f"no prompts in {path}")


def require_rows(df: DataFrame, problem: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(problem)
    return df
