"""Text expressions with Python's idea of white space, which is Unicode's and four control characters."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS = r"(?U)[\s\x1c-\x1f]"
# The cell texts that count as missing when a CSV is read.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+$", "")


def norm_spaces(c: Column) -> Column:
    """Stripped, runs of white space as one space, one final full stop dropped (a blank before it stays)."""
    return F.regexp_replace(F.regexp_replace(strip(c), f"{WS}+", " "), r"\.$", "")


def null_if_na(c: Column, tokens: Iterable[str] = NA_TOKENS) -> Column:
    return F.when(~c.isin(*tokens), c)


def truncate(c: Column, length: int = 120) -> Column:
    """At most `length` characters, with an ellipsis if there were more; null as empty."""
    c = F.coalesce(c, F.lit(""))
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit("…"))).otherwise(c)


def slug(text: str) -> str:
    return re.sub(r"[^a-zA-Z0-9]+", "_", text).strip("_").lower()


def slug_column(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))


def column_name(c: Column) -> Column:
    """A header as an identifier: runs of anything but letters, digits and underscores, and of underscores, become one underscore; none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)[\W_]+", "_"), "^_+|_+$", "")


def normalised_columns(df: DataFrame) -> DataFrame:
    """The table with all its column names normalised; names that meet are an error."""
    names = [re.sub(r"[\W_]+", "_", n).strip("_") for n in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"column names meet: {sorted(n for n in names if names.count(n) > 1)}")
    return df.toDF(*names)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The base name without its last extension; a leading dot isn't one."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", "")


def item_count(c: Column) -> Column:
    """Comma-separated items; the empty text has one."""
    return F.size(F.split(c, ","))


def contains_any(c: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.lower(c), F.lit(w.lower()))
    return out


def prefixed_lines(node: Column, line: Column) -> Column:
    return F.concat(F.lit("["), node, F.lit("] "), line)
