"""Top-level keys of JSON records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keys(line: Column) -> Column:
    """In document order; none for a blank line, invalid JSON, or anything but an object."""
    return F.coalesce(F.json_object_keys(line), F.array().cast("array<string>"))


def padded(df: DataFrame, values: str, prefix: str = "key") -> DataFrame:
    """The array column as columns key1, key2, ... up to its greatest length, the rest of shorter ones empty. A table without rows is an error."""
    width = df.agg(F.max(F.size(values))).first()[0]  # one number
    if width is None:
        raise ValueError("no rows")
    return df.select(*[c for c in df.columns if c != values], *[F.coalesce(F.get(F.col(values), F.lit(k)), F.lit("")).alias(f"{prefix}{k + 1}") for k in range(width)])
