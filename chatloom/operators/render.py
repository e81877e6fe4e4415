"""Chat templates as data, rendered by column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .records import message


@dataclass(frozen=True)
class ChatTemplate:
    """Prefix and suffix per role; messages of other roles are left out."""

    roles: Mapping[str, tuple[str, str]]
    generation: str = ""
    default_role: str = "user"
    start: str = field(default="")


def chatml() -> ChatTemplate:
    """The template used when a tokenizer brings none."""
    # Turn marks
    begin, end = "<|im_start|>", "<|im_end|>\n"
    roles = {role: (f"{begin}{role}\n", end) for role in ("system", "user", "assistant")}
    return ChatTemplate(roles, generation=f"{begin}assistant\n")


CHATML = chatml()


def segment(role: Column, content: Column, template: ChatTemplate = CHATML) -> Column:
    """Rendered text of one message; empty for roles outside the template."""
    role = F.coalesce(role, F.lit(template.default_role))
    content = F.coalesce(content, F.lit(""))
    text = F.lit("")
    for name, (prefix, suffix) in reversed(list(template.roles.items())):
        text = F.when(role == name, F.concat(F.lit(prefix), content, F.lit(suffix))).otherwise(text)
    return text


def is_rendered(role: Column, template: ChatTemplate = CHATML) -> Column:
    return F.coalesce(role, F.lit(template.default_role)).isin(*template.roles)


def render(messages: Column, template: ChatTemplate = CHATML, add_generation_prompt: bool = False) -> Column:
    """Text of a message list."""
    body = F.array_join(F.transform(messages, lambda m: segment(m["role"], m["content"], template)), "")
    parts = [F.lit(template.start), body] if template.start else [body]
    if add_generation_prompt:
        parts.append(F.lit(template.generation))
    return F.concat(*parts)


def dropped_messages(messages: Column, template: ChatTemplate = CHATML) -> Column:
    """How many messages the template leaves out."""
    return F.size(F.filter(messages, lambda m: ~is_rendered(m["role"], template)))


def render_training_text(df: DataFrame, template: ChatTemplate = CHATML, messages: str = "messages") -> DataFrame:
    """Replace the messages by the training text."""
    return df.withColumn("text", render(F.col(messages), template)).drop(messages)


def single_prompt(prompt: Column, template: ChatTemplate = CHATML, system: str | None = None) -> Column:
    """Prompt for one question. A system prompt is used only when given here."""
    turns = [message("user", prompt)]
    if system is not None:
        turns.insert(0, message("system", F.lit(system)))
    return render(F.array(*turns), template, add_generation_prompt=True)


def render_with(function: Callable, messages: Column) -> Column:
    """Render by a user function over a batch of message lists (pandas Series -> pandas Series)."""
    return F.pandas_udf(function, StringType())(messages)
