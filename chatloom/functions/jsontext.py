"""JSON records held as text: validity, field text and truthiness without Python in the loop.

A record is parsed once by ``from_json`` with an all-string schema, so numbers
and nested values keep their text. The JSON type of a value is looked up only
where the text alone cannot tell (``0`` or ``"0"``, ``{..}`` or ``"{..}"``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import ANSWER_KEYS, MESSAGES_TYPE, QUESTION_KEYS

_END = "<end of record>"
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
_FIELDS = ", ".join(f"{name}: string" for name in QUESTION_KEYS + ANSWER_KEYS)
_ENVELOPE = f"r struct<{_FIELDS}, messages: {MESSAGES_TYPE}>, e string"
_FALSY_TEXT = r"^(-?0+(\.0*)?([eE][-+]?[0-9]+)?|false|\[\]|\{\})$"


def parse_record(df: DataFrame, value: str = "value") -> DataFrame:
    """Add ``record`` (struct of known fields, null unless an object) and ``is_json``.

    The text is parsed inside an envelope, so anything left over after the value
    makes the whole parse fail instead of being ignored. ``inline`` keeps the
    parse in one place: filters on the result would otherwise repeat it.
    """
    raw = F.col(value)
    envelope = F.concat(F.lit('{"r":'), raw, F.lit(f',"e":"{_END}"}}'))
    listed = F.concat(F.lit("["), raw, F.lit(f',"{_END}"]'))
    parsed = F.struct(
        F.from_json(envelope, _ENVELOPE, _STRICT).alias("_parsed"), F.json_array_length(listed).alias("_listed")
    )
    whole = (F.col("_parsed.e") == _END) & (F.col("_listed") == 2)
    return (
        df.select("*", F.inline(F.array(parsed)))
        .withColumn("is_json", F.coalesce(whole, F.lit(False)))
        .withColumn("record", F.when(F.col("is_json"), F.col("_parsed.r")))
        .drop("_parsed", "_listed")
    )


def json_keys(value: Column) -> Column:
    """Distinct keys of an object in document order; null when it is not an object."""
    return F.array_distinct(F.json_object_keys(value))


def json_kind(value: Column, field) -> Column:
    """Type name of one field (a name or a column of names), such as STRING or OBJECT<...>."""
    path = F.concat(F.lit("$."), field) if isinstance(field, Column) else F.lit(f"$.{field}")
    return F.schema_of_variant(F.try_variant_get(F.try_parse_json(value), path, "variant"))


def is_truthy(field: str, value: str = "value", record: str = "record") -> Column:
    """False for a missing or null field, "", 0, false, [] and {}."""
    text = F.col(f"{record}.{field}")
    looks_falsy = (F.octet_length(text) <= 32) & text.rlike(_FALSY_TEXT)
    return (
        F.when(text.isNull() | (text == ""), F.lit(False))
        .when(looks_falsy, F.coalesce(json_kind(F.col(value), field) == "STRING", F.lit(False)))
        .otherwise(F.lit(True))
    )


def first_truthy_field(fields, value: str = "value", record: str = "record") -> Column:
    """Name and text of the first truthy field, else null."""
    found = [
        F.when(is_truthy(f, value, record), F.struct(F.lit(f).alias("name"), F.col(f"{record}.{f}").alias("text")))
        for f in fields
    ]
    return F.coalesce(*found)


def first_truthy(fields, value: str = "value", record: str = "record") -> Column:
    """Text of the first truthy field, else null."""
    return F.coalesce(*[F.when(is_truthy(f, value, record), F.col(f"{record}.{f}")) for f in fields])


def has_keys(keys: Column, names) -> Column:
    """True when every name is among the keys."""
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, names)), keys)) == 0, F.lit(False))


def has_any_keyset(keys: Column, keysets) -> Column:
    return reduce(lambda a, b: a | b, [has_keys(keys, names) for names in keysets])
