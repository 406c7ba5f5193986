"""Profiles of tables and evaluation sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.statistics import interval_half

#: Spark types as a data-frame library would name them.
DTYPES = {"bigint": "int64", "int": "int64", "double": "float64", "float": "float64", "boolean": "bool"}


def missing_report(df: DataFrame, *columns: str) -> DataFrame:
    """(column, missing_fraction) of each column, most missing first; one pass over the table."""
    columns = columns or tuple(df.columns)
    fractions = df.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("missing_fraction")) for c in columns])
    return fractions.select(F.explode(rows).alias("r")).select("r.*").orderBy(F.desc("missing_fraction"), "column")


def data_dictionary(df: DataFrame, table: str, order: str) -> DataFrame:
    """(table, column, dtype, example): the example is the first value, in the order of a column, that isn't null."""
    kinds = dict(df.dtypes)
    examples = df.agg(*[F.min_by(F.col(f"`{c}`").cast("string"), F.when(F.col(f"`{c}`").isNotNull(), F.col(order))).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(table).alias("table"), F.lit(c).alias("column"), F.lit(DTYPES.get(kinds[c], "object")).alias("dtype"), F.col(f"`{c}`").alias("example")) for c in df.columns])
    return examples.select(F.explode(rows).alias("r")).select("r.*")


def mean_interval(df: DataFrame, by: str, *metrics: str, digits: int = 2) -> DataFrame:
    """For each group and metric: n, mean, and the ends of the two-sided 95 % t interval, rounded."""
    parts = []
    for m in metrics:
        parts.append(F.struct(F.lit(m).alias("metric"), F.count(m).alias("n"), F.avg(m).alias("mean"), interval_half(m).alias("half")).alias(f"m_{m}"))
    grouped = df.groupBy(by).agg(*parts).select(by, F.explode(F.array(*[f"m_{m}" for m in metrics])).alias("r")).select(by, "r.*")
    return grouped.select(by, "metric", "n", *[F.round(c, digits).alias(n) for n, c in (("mean", F.col("mean")), ("low", F.col("mean") - F.col("half")), ("high", F.col("mean") + F.col("half")))])


# Fixed value: a number or a fraction, and nothing else.
NUMERIC = r"^\s*[-+]?(\d+(\.\d+)?|\d+/\d+)\s*$"


def numeric_share(df: DataFrame, c: Column) -> DataFrame:
    """(share): how much of the values that aren't null look like a number or a fraction."""
    return df.agg(F.avg(F.rlike(c.cast("string"), F.lit(NUMERIC)).cast("double")).alias("share"))
