"""Shares of categories, proportional quotas, and exact samples by quota."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .names import unused
from .ranking import first_rows, hash_bucket, hash_key, in_order, numbered

# Rows of each category in the benchmark's sample of 500.
QUOTA = {
    "Math": 226,
    "Computer Science/AI": 52,
    "Biology/Medicine": 51,
    "Physics": 47,
    "Humanities/Social Science": 45,
    "Other": 41,
    "Chemistry": 23,
    "Engineering": 15,
}


def frequencies(df: DataFrame, by: str) -> DataFrame:
    """Rows of each category, nulls left out, most frequent first."""
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


def allocation(df: DataFrame, by: str, size: int = 500) -> DataFrame:
    """(category, n, share, quota): the share is of all rows, also those without a category; quotas round half to even and needn't sum to `size`."""
    counts = df.groupBy(by).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0  # one number
    share = F.col("n") / F.lit(float(total or 1))
    return counts.where(F.col(by).isNotNull()).select(by, "n", share.alias("share"), F.bround(share * float(size)).cast("bigint").alias("quota"))


def members(df: DataFrame, by: str, key: str, size: int = 1000, seed: int = 2025) -> DataFrame:
    """(category, part, members): the keys of each category as sorted arrays of at most `size`, dealt to them by a seeded shuffle. No category meets in one task or row."""
    parts = membership(df, by, key, seed).withColumn("part", F.floor(F.col("place") / size))
    return parts.groupBy(by, "part").agg(F.sort_array(F.collect_list(key)).alias("members"))


def membership(df: DataFrame, by: str, key: str, seed: int = 2025) -> DataFrame:
    """(category, key, place): every row's key, numbered from 0 within its category in a seeded shuffle. No category meets in one task."""
    slim = df.select(by, key)
    digest, = unused(slim.columns, "digest")
    keyed = slim.withColumn(digest, hash_key(seed, key))
    return numbered(keyed, hash_bucket(F.col(digest)), [digest, key], within=(by,), name="place").select(by, key, "place")


def quota_table(df: DataFrame, quotas: dict[str, int], by: str = "category") -> DataFrame:
    return df.sparkSession.createDataFrame(sorted(quotas.items()), f"`{by}` string, quota long")


def missing_categories(quotas: DataFrame, df: DataFrame, by: str) -> DataFrame:
    """Quotas of categories that have no rows."""
    return quotas.join(df.select(by).distinct(), by, "left_anti")


def short_categories(quotas: DataFrame, df: DataFrame, by: str) -> DataFrame:
    """(category, quota, n) of those with rows, but fewer than their quota."""
    return quotas.join(df.groupBy(by).agg(F.count("*").alias("n")), by).where("n < quota")


def quota_sample(df: DataFrame, quotas: DataFrame, by: str, key: str, seed: int = 2025, strict: bool = True) -> DataFrame:
    """Exactly `quota` rows of each category of (category, quota), the first in a seeded shuffle.

    A category with too few rows is an error, or with strict off gives all it has; one without rows gives none.
    """
    if strict:
        short = short_categories(quotas, df, by).limit(5).collect()
        if short:
            raise ValueError(f"quotas above the number of rows: {[tuple(r) for r in short]}")
    digest, first = unused(df.columns, "digest", "drawn")
    sizes = quotas.select(by, F.col("quota").alias("size"))
    drawn = first_rows(df.withColumn(digest, hash_key(seed, key)), digest, key, sizes, within=(by,), name=first)
    return drawn.where(first).select(*df.columns)


def size_report(df: DataFrame, size: int) -> DataFrame:
    """(n, expected, complete): whether a sample has as many rows as it should; a warning, not an error, as quotas needn't sum to the size."""
    return df.agg(F.count("*").alias("n")).select("n", F.lit(size).cast("bigint").alias("expected"), (F.col("n") == size).alias("complete"))


def first(df: DataFrame, n: int) -> DataFrame:
    """The first n rows in the order of the files they are read from."""
    place, = unused(df.columns, "source_order")
    return in_order(df, place).orderBy(place).limit(n).drop(place)


def full_rows(source: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """The rows of the unfiltered source whose keys were chosen."""
    return source.join(chosen.select(key), key, "left_semi")


def without(df: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    return df.join(chosen.select(key), key, "left_anti")


def dropped(df: DataFrame, *columns: str) -> DataFrame:
    """Without the named columns, all of which must be there."""
    absent = set(columns) - set(df.columns)
    if absent:
        raise ValueError(f"no such columns: {sorted(absent)}")
    return df.drop(*columns)
