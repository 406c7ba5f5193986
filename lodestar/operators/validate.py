"""Rules that records must keep, checked when the plan is made or counted over whole tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import unused

REQUIRED = ("data_source", "prompt", "ability", "reward_model", "extra_info")


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The table itself; an error names the columns that aren't there. Case counts."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns {absent}; there are {df.columns[:20]}")
    return df


def renamed_id(df: DataFrame) -> DataFrame:
    """`ID` becomes `id`, if it is there in just that case."""
    return df.withColumnRenamed("ID", "id") if "ID" in df.columns and "id" not in df.columns else df


def id_first(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(["id"] if "id" in df.columns else []), *columns)


def complete(df: DataFrame, *columns: str) -> DataFrame:
    """Rows that have all the named columns."""
    return df.dropna(subset=list(columns))


def without_value(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text is there and empty, such as questions without an image; a null isn't empty."""
    return df.where(F.col(f"`{column}`") == "")


def rules(df: DataFrame, extra: Mapping[str, Column] | None = None) -> dict[str, Column]:
    """What unified records must keep, by name: true where a row does. A null ground truth is allowed; `extra` adds rules, for which null counts as broken.

    A table without the columns and fields that records have is an error.
    """
    require_columns(df, REQUIRED)
    fields = {f.name: f.dataType for f in df.schema.fields}
    if "ground_truth" not in fields["reward_model"].fieldNames():
        raise ValueError("reward_model has no ground_truth")
    if not {"role", "content"} <= set(fields["prompt"].elementType.fieldNames()):
        raise ValueError("prompt turns need role and content")
    known = {
        "prompt has a turn": F.size("prompt") >= 1,
        "turns are whole": F.coalesce(~F.exists("prompt", lambda t: t["role"].isNull() | t["content"].isNull()), F.lit(True)),
    }
    return {name: F.coalesce(ok, F.lit(False)) for name, ok in (known | dict(extra or {})).items()}


def violations(df: DataFrame, sample: int | None = None, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """(rule, violations) of unified records: over all rows, or the first `sample`."""
    checks = rules(df, extra)
    counts = (df if sample is None else df.limit(sample)).agg(*[F.coalesce(F.sum((~ok).cast("bigint")), F.lit(0)).alias(name) for name, ok in checks.items()])
    rows = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"`{name}`").alias("violations")) for name in checks])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def judged(df: DataFrame, extra: Mapping[str, Column] | None = None, name: str = "broken") -> DataFrame:
    """Adds the names of the rules that each record breaks, in the order of the rules; none for a good record."""
    told = F.array(*[F.when(~ok, rule) for rule, ok in rules(df, extra).items()])
    return df.withColumn(name, F.filter(told, lambda r: r.isNotNull()))


def quarantined(df: DataFrame, path: str, extra: Mapping[str, Column] | None = None, name: str = "broken") -> tuple[DataFrame, DataFrame]:
    """(good, bad) records, parted in one pass over the table: written to Parquet below path, as good and bad ones, and read back. Bad ones carry the rules they break.

    Every row is in one of the two. Writing again replaces both.
    """
    part, = unused([*df.columns, name], "part")
    marked = judged(df, extra, name)
    marked.withColumn(part, F.when(F.size(name) == 0, "good").otherwise("bad")).write.mode("overwrite").partitionBy(part).parquet(path)
    back = df.sparkSession.read.schema(marked.schema.add(part, "string")).parquet(path)
    return back.where(F.col(part) == "good").drop(part, name), back.where(F.col(part) == "bad").drop(part)
