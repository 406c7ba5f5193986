"""Reference answers out of free text, one expression for each way that data sets mark them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, norm_spaces

# How answers are marked.
HASHES = rf"(?s)####{WS[4:]}*(.+)$"
BOXED = r"\\boxed\{([^}]+)\}"
NUMBER = r"[-+]?\d*\.?\d+"


def copied(c: Column) -> Column:
    return norm_spaces(c)


def _first_group(c: Column, pattern: str) -> Column:
    """Group 1 of the first match, normalised; the whole text, normalised, without a match."""
    return F.when(F.rlike(c, F.lit(pattern)), norm_spaces(F.regexp_extract(c, pattern, 1))).otherwise(norm_spaces(c))


def after_hashes(c: Column) -> Column:
    """What follows the first ####, to the end of the text."""
    return _first_group(c, "(?U)" + HASHES)


def boxed(c: Column) -> Column:
    r"""The content of the first \boxed{...}, up to the first closing brace."""
    return _first_group(c, BOXED)


def numeric(c: Column) -> Column:
    """The last number, as it stands; without one, the normalised text."""
    return F.coalesce(F.try_element_at(F.regexp_extract_all(c, F.lit("(?U)" + NUMBER), F.lit(0)), F.lit(-1)), norm_spaces(c))


def by_pattern(c: Column, pattern: str | None) -> Column:
    """Group 1 of a pattern of the caller; the dot matches line ends. A group that takes no part gives the empty text."""
    if not pattern:
        raise ValueError("extractor regex_group1 needs a pattern")
    if "(?P" in pattern:
        raise ValueError("named groups are written (?<name>...)")
    return _first_group(c, "(?s)" + pattern)


def extracted(c: Column, extractor: str, pattern: str | None = None) -> Column:
    """By the name of the extractor; an unknown name copies. Null stays null; other types are cast to text first."""
    text = c.cast("string")
    ways = {"after_hash4": after_hashes, "boxed": boxed, "numeric": numeric}
    if extractor == "regex_group1":
        return by_pattern(text, pattern)
    return ways.get(extractor, copied)(text)
