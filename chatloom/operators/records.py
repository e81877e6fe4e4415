"""Raw records of any supported format -> ``messages``.

All functions work on batch and streaming DataFrames alike: they are
projections of one row to one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    ALPACA_ANSWER_KEYS, ALPACA_KEY_SETS, ANSWER_KEYS, CSV_ALPACA_ANSWER_COLUMNS, CSV_ANSWER_COLUMNS,
    CSV_QUESTION_COLUMNS, MESSAGES_TYPE, QA_KEY_SETS, QUESTION_KEYS,
)
from ..functions.jsontext import (
    first_truthy, first_truthy_field, has_any_keyset, is_truthy, json_keys, json_kind, parse_record,
)
from ..functions.text import concat_if, strip


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.coalesce(content, F.lit("")).alias("content"))


def dialogue(question: Column, answer: Column) -> Column:
    """A user message and an assistant message, both stripped."""
    return F.array(message("user", strip(question)), message("assistant", strip(answer)))


def text_messages(text: Column) -> Column:
    """A lone assistant message."""
    return F.array(message("assistant", text))


def sharegpt_messages(record: str = "record") -> Column:
    """The messages of a chat record; content is never null."""
    return F.transform(
        F.col(f"{record}.messages"),
        lambda m: F.struct(m["role"].alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")),
    )


def _alpaca_sides(parsed: DataFrame, value: str) -> DataFrame:
    """Instruction and optional input as the question, output or response as the answer."""
    instruction = F.coalesce(F.col("record.instruction"), F.lit(""))
    question = concat_if(instruction, is_truthy("input", value), F.col("record.input"))
    return parsed.withColumn("_question", question).withColumn("_answer", first_truthy(ALPACA_ANSWER_KEYS, value))


def _qa_sides(parsed: DataFrame, value: str) -> DataFrame:
    """First truthy question and answer; an answer object gives its ``text`` or itself."""
    sides = parsed.withColumn("_question", first_truthy(QUESTION_KEYS, value))
    sides = sides.withColumn("_found", first_truthy_field(ANSWER_KEYS, value))
    answer = F.col("_found.text")
    # text in braces may be a string: its JSON type decides
    is_object = F.when(
        F.startswith(answer, F.lit("{")), F.startswith(json_kind(F.col(value), F.col("_found.name")), F.lit("OBJECT"))
    )
    inner = F.coalesce(F.from_json(answer, "text string")["text"], F.lit(""))
    has_text = F.array_contains(json_keys(answer), "text")
    return sides.withColumn("_answer", F.when(is_object & has_text, inner).otherwise(answer)).drop("_found")


_SIDES = {"alpaca": _alpaca_sides, "jsonl": _qa_sides}


def to_messages(df: DataFrame, fmt: str, value: str = "value", on_bad: str = "fail") -> DataFrame:
    """Replace the JSON text column by ``messages``.

    A record that is not a JSON object, or a chat record without messages, fails
    the query (``on_bad="fail"``) or gets null messages (``"null"``). No row is dropped.
    """
    parsed = parse_record(df, value)
    if fmt == "sharegpt":
        messages = sharegpt_messages()
    else:
        parsed = _SIDES[fmt](parsed, value)
        messages = dialogue(F.col("_question"), F.col("_answer"))
    messages = F.when(F.col("record").isNotNull(), messages).cast(MESSAGES_TYPE)
    if on_bad == "fail":
        failure = F.raise_error(F.concat(F.lit("bad record: "), F.left(value, F.lit(200))))
        messages = F.coalesce(messages, failure.cast(MESSAGES_TYPE))
    return parsed.withColumn("messages", messages).drop("record", "is_json", "_question", "_answer", value)


def record_format(df: DataFrame, value: str = "value", name: str = "format") -> DataFrame:
    """Add the format of every JSON record, null when none fits.

    A chat record needs a non-empty list of objects that all have a role and a content.
    """
    keys = json_keys(F.col(value))
    turns = F.from_json(F.col(value), "messages array<map<string,string>>")["messages"]
    complete = F.forall(
        turns,
        lambda m: F.coalesce(F.map_contains_key(m, "role") & F.map_contains_key(m, "content"), F.lit(False)),
    )
    chat = F.array_contains(keys, "messages") & (F.size(turns) > 0) & complete
    return (
        df.withColumn("_keys", keys)
        .withColumn(
            name,
            F.when(F.coalesce(chat, F.lit(False)), F.lit("sharegpt"))
            .when(has_any_keyset(F.col("_keys"), ALPACA_KEY_SETS), F.lit("alpaca"))
            .when(has_any_keyset(F.col("_keys"), QA_KEY_SETS), F.lit("jsonl")),
        )
        .drop("_keys")
    )


# ---- CSV ------------------------------------------------------------------


def _last_position(header: Column, name: str) -> Column:
    """1-based place of the last column with this name, null when there is none."""
    from_end = F.array_position(F.reverse(header), name)
    return F.when(from_end > 0, F.size(header) + 1 - from_end)


def _first_named(header: Column, names) -> Column:
    """Place of the first column, in header order, that has one of the names."""
    places = F.filter(F.sequence(F.lit(1), F.size(header)), lambda i: F.element_at(header, i).isin(*names))
    name = F.element_at(header, F.get(places, F.lit(0)))
    return F.size(header) + 1 - F.array_position(F.reverse(header), name)


def csv_plan(header: Column) -> Column:
    """Which columns make the question and the answer, worked out once per file."""
    has = lambda names: F.arrays_overlap(header, F.array(*map(F.lit, names)))
    instruction = F.array_contains(header, "instruction")
    named = has(CSV_QUESTION_COLUMNS) & has(CSV_ANSWER_COLUMNS)
    by_name = lambda names: _first_named(header, names)
    none = F.lit(None).cast("int")
    answers = [_last_position(header, n).cast("int") for n in CSV_ALPACA_ANSWER_COLUMNS]
    second = F.when(F.size(header) > 1, F.lit(2))
    return F.struct(
        F.when(instruction, _last_position(header, "instruction"))
        .when(named, by_name(CSV_QUESTION_COLUMNS))
        .otherwise(F.lit(1)).cast("int").alias("question"),
        F.when(instruction, _last_position(header, "input")).otherwise(none).cast("int").alias("input"),
        F.when(instruction, F.array(*answers))
        .when(named, F.array(by_name(CSV_ANSWER_COLUMNS).cast("int")))
        .otherwise(F.array(second.cast("int"))).alias("answers"),
    )


def csv_messages(plan: Column, cells: Column) -> Column:
    """Messages of one row: empty and missing cells count as absent."""
    at = lambda i: F.when(i.isNotNull() & (i <= F.size(cells)), F.element_at(cells, i))
    question = F.coalesce(at(plan["question"]), F.lit(""))
    extra = F.coalesce(at(plan["input"]), F.lit(""))
    found = F.filter(
        F.transform(plan["answers"], lambda i: F.coalesce(at(i), F.lit(""))), lambda a: a != ""
    )
    return dialogue(concat_if(question, extra != "", extra), F.coalesce(F.get(found, F.lit(0)), F.lit("")))
