"""Train and validation splits, exact in size and fixed by a seed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import unused
from .ranking import first_rows, hash_key, numbered, range_bucket

SEED = 2025
RATIO = 0.02
NO_STRATUM = "__NO_TOPIC__"


@dataclass(frozen=True)
class Strategy:
    """How to split: `existing`, `random` or `stratified` by a column; anything else is random."""

    kind: str = "random"
    by: str | None = None
    ratio: float = RATIO


def _drawn(df: DataFrame, key: str, ratio: float, seed: int, stratum: Column | None = None) -> DataFrame:
    """Adds `split`: the first max(1, floor(n * ratio)) rows of each stratum in a seeded shuffle are val; ratios are doubles."""
    digest, part, first = unused(df.columns, "digest", "stratum", "drawn")
    shuffled = df.drop("split").withColumn(digest, hash_key(seed, key))
    if stratum is not None:
        shuffled = shuffled.withColumn(part, stratum)
    size = lambda rows: F.greatest(F.lit(1), F.floor(rows * F.lit(float(ratio))))
    marked = first_rows(shuffled, digest, key, size, within=() if stratum is None else (part,), name=first)
    return marked.withColumn("split", F.when(F.col(first), "val").otherwise("train")).drop(first, digest, part)


def random_split(df: DataFrame, key: str, ratio: float = RATIO, seed: int = SEED) -> DataFrame:
    """Adds `split`. A table of one row is all val."""
    return _drawn(df, key, ratio, seed)


def stratified_split(df: DataFrame, key: str, by: str, ratio: float = RATIO, seed: int = SEED) -> DataFrame:
    """Adds `split`, drawn in each stratum; strata are values as text, nulls one stratum. A stratum of one row is all val."""
    return _drawn(df, key, ratio, seed, F.coalesce(F.col(by).cast("string"), F.lit(NO_STRATUM)))


def split(train: DataFrame | None, val: DataFrame | None, key: str, strategy: Strategy, seed: int = SEED) -> DataFrame:
    """One table with `split`. A val table that is there settles it; without one, the strategy does."""
    if train is None:
        raise ValueError("there is no train split")
    if val is not None:
        return train.withColumn("split", F.lit("train")).unionByName(val.withColumn("split", F.lit("val")))
    if strategy.kind == "stratified" and strategy.by:
        return stratified_split(train, key, strategy.by, strategy.ratio, seed)
    return random_split(train, key, strategy.ratio, seed)


def indexed(df: DataFrame, source_index: str, name: str = "index", source: DataFrame | None = None) -> DataFrame:
    """Adds 0, 1, ... within each split, in source order: that of a number, a text, or the place that in_order adds. `source` is a table with the same keys that is cheaper to read."""
    return numbered(df, range_bucket(df, source_index, source=source), [source_index], within=("split",), name=name)


def generated_ids(df: DataFrame, source_index: str, stem: str, name: str = "id") -> DataFrame:
    """Adds `{stem}-000000`, ... in source order: that of a number, a text, or the place that in_order adds."""
    place, = unused(df.columns, "drawn")
    placed = numbered(df, range_bucket(df, source_index), [source_index], name=place)
    return placed.withColumn(name, F.format_string(f"{stem.replace('%', '%%')}-%06d", F.col(place))).drop(place)
