"""Nested training records: chat turns, question/answer structs, prompts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import rstrip, strip


def turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def thought(think: Column | None, nan_text: bool = False) -> Column:
    """The stripped reasoning; null is empty, or the text `nan` if nan_text asks for what an untyped reader would write."""
    if think is None:
        return F.lit("")
    return F.coalesce(strip(think), F.lit("nan" if nan_text else ""))


def answer_text(answer: Column, think: Column | None = None, tags: bool = True, nan_text: bool = False) -> Column:
    """The answer wrapped with its reasoning in tags, or plain."""
    if not tags:
        return strip(answer)
    return F.concat(F.lit("<think>"), thought(think, nan_text), F.lit("</think><answer>"), strip(answer), F.lit("</answer>"))


def messages(question: Column, answer: Column, think: Column | None = None, system: str = "", tags: bool = True, nan_text: bool = False) -> Column:
    """Chat turns: system if there is such a prompt, user, assistant."""
    turns = [turn("system", F.lit(system))] if system else []
    return F.array(*turns, turn("user", strip(question)), turn("assistant", answer_text(answer, think, tags, nan_text)))


def question_answer(question: Column, answer: Column, think: Column | None = None, tags: bool = True) -> Column:
    return F.struct(strip(question).alias("question"), answer_text(answer, think, tags).alias("answer"))


def filled(template: str, **values: Column | str) -> Column:
    """A template whose {names} are replaced, once: braces inside the values stay as they are. {{ and }} are braces."""
    parts = []
    for literal, name in re.findall(r"((?:\{\{|\}\}|[^{}])+)|\{(\w+)\}", template):
        if name:
            value = values[name]
            parts.append(F.lit(value) if isinstance(value, str) else value)
        else:
            parts.append(F.lit(literal.replace("{{", "{").replace("}}", "}")))
    return F.concat(*parts) if parts else F.lit("")


def user_prompt(template: str, question: Column, instruction: str, strict_nulls: bool = True) -> Column:
    """A single user turn. A null question gives a null content, or with strict_nulls off the text `None`."""
    text = rstrip(question.cast("string"))
    if not strict_nulls:
        text = F.coalesce(text, F.lit("None"))
    return F.array(turn("user", filled(template, question=text, instruction=instruction)))


def flattened(df: DataFrame, *columns: str) -> DataFrame:
    """The named struct columns as plain ones, `outer.inner`, at any depth."""
    from pyspark.sql import types as T

    out = []

    def walk(path: str, name: str, kind) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f"{path}.`{f.name}`", f"{name}.{f.name}", f.dataType)
        else:
            out.append(F.col(path).alias(name))

    for field in df.schema.fields:
        if field.name in columns:
            walk(f"`{field.name}`", field.name, field.dataType)
        else:
            out.append(F.col(f"`{field.name}`"))
    return df.select(*out)


def first_content(turns: Column) -> Column:
    return F.get(turns, F.lit(0))["content"]
