"""Text expressions (Column -> Column), all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import WHITESPACE


def strip(text: Column) -> Column:
    """Trim every Unicode whitespace character from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def concat_if(head: Column, condition: Column, tail: Column, separator: str = "\n\n") -> Column:
    """``head``, followed by the separator and ``tail`` where the condition holds."""
    return F.concat(head, F.when(condition, F.concat(F.lit(separator), tail)).otherwise(F.lit("")))


def preview(text: Column, length: int, always: bool = False) -> Column:
    """First characters and an ellipsis: only for longer text unless ``always``."""
    head = F.left(text, F.lit(length))
    if always:
        return F.concat(head, F.lit("..."))
    return F.concat(head, F.when(F.char_length(text) > length, F.lit("...")).otherwise(F.lit("")))


def escaped_preview(text: Column, length: int = 200) -> Column:
    """Preview on one line: newlines are shown as a backslash and an n."""
    head = F.replace(F.left(text, F.lit(length)), F.lit("\n"), F.lit("\\n"))
    return F.concat(head, F.when(F.char_length(text) > length, F.lit("...")).otherwise(F.lit("")))


def _one_decimal(value: Column) -> Column:
    """Text with one decimal, rounded by the exact binary value with halves to even.

    ``format_string`` and ``bround`` look at the shortest decimal form instead
    (0.35 is slightly less than 35/100). The value is split so that its distance
    from the half-way point is computed without rounding.
    """
    tenths = F.floor(value * 10)
    high = F.floor(value * 2**20) / 2**20
    over_half = (high * 20 - (tenths * 2 + 1)) + (value - high) * 20
    rounded = F.when(over_half > 0, tenths + 1).when(over_half < 0, tenths).otherwise(tenths + tenths % 2)
    return F.format_string("%d.%d", F.floor(rounded / 10), (rounded % 10).cast("bigint"))


def _scaled(value: Column, steps) -> Column:
    """Value divided and labelled by the first step whose condition holds; steps are (condition, divisor, unit)."""
    *some, (_, last_divisor, last_unit) = steps
    divisor, unit = F, F
    for condition, size, label in some:
        divisor, unit = divisor.when(condition, F.lit(size)), unit.when(condition, F.lit(label))
    divisor, unit = divisor.otherwise(F.lit(last_divisor)), unit.otherwise(F.lit(last_unit))
    return F.concat(_one_decimal(value / divisor), unit)


def human_size(size: Column) -> Column:
    """Bytes as B, KB, MB or GB."""
    kb, mb, gb = 1024, 1024**2, 1024**3
    small = F.concat(size.cast("bigint").cast("string"), F.lit(" B"))
    scaled = _scaled(size, [(size < mb, kb, " KB"), (size < gb, mb, " MB"), (None, gb, " GB")])
    return F.when(size < kb, small).otherwise(scaled)


def human_count(count: Column) -> Column:
    """Counts in thousands, millions or billions."""
    return _scaled(count, [(count > 10**9, 1e9, "B"), (count > 10**6, 1e6, "M"), (None, 1e3, "K")])


def clock(time: Column) -> Column:
    """Time of day, as log lines show it."""
    return F.date_format(time, "HH:mm:ss")
