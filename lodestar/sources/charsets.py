"""Charsets that Spark doesn't read or write itself, by codecs in the plan: no session setting is needed or changed.

Bytes pass through Spark's CSV reader and writer as ISO-8859-1, which maps each byte to a character and back; cells are decoded or encoded in Arrow batches. This
is right where no character but the mark itself has the byte of a quote, a comma or a line end, as in the codecs named here.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Spark reads and writes itself, and Python's names of codecs whose further bytes are never those of ASCII marks below the digits.
NATIVE = {"utf-8": "UTF-8", "utf8": "UTF-8", "utf-8-sig": "UTF-8", "us-ascii": "US-ASCII", "ascii": "US-ASCII", "utf-16": "UTF-16", "utf-32": "UTF-32"}
BYTEWISE = ("cp932", "shift_jis", "euc_jp", "gbk", "big5", "euc_kr", "cp949", "cp1252", "latin-1", "iso8859-15", "koi8-r", "cp1251")
#: A character for each byte.
BYTES = "ISO-8859-1"


def codec(encoding: str) -> str | None:
    """The Python codec that cells of an encoding need; None if Spark reads it. An encoding that neither knows is an error."""
    name = encoding.lower()
    if name in NATIVE:
        return None
    name = {"windows-31j": "cp932", "ms932": "cp932", "sjis": "shift_jis", "shift-jis": "shift_jis", "iso-8859-1": "latin-1"}.get(name, name.replace("windows-", "cp"))
    if name not in BYTEWISE:
        raise ValueError(f"unknown charset {encoding!r}; known: {sorted(NATIVE) + list(BYTEWISE)}")
    return name


def _by_codec(function, kind: str):
    import pandas as pd

    def mapped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series([None if v is None else function(v) for v in values], dtype=object)

    mapped.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(mapped, kind)


def decoded(cell: Column, name: str, errors: str = "strict") -> Column:
    """Text of a cell whose characters stand for bytes."""
    return _by_codec(lambda b: bytes(b).decode(name, errors), "string")(F.encode(cell, BYTES))


def encoded(cell: Column, name: str, errors: str = "strict") -> Column:
    """A cell whose characters stand for the bytes of a text."""
    return F.decode(_by_codec(lambda s: s.encode(name, errors), "binary")(cell), BYTES)


def decoded_name(name: str, codec_name: str) -> str:
    return name.encode("latin-1").decode(codec_name)


def encoded_name(name: str, codec_name: str) -> str:
    return name.encode(codec_name).decode("latin-1")
