"""Row numbers that no single task computes: buckets in order, a count for each, and ranks within buckets."""

from __future__ import annotations

import json

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .names import unused
from .scratch import scratch


def hash_key(seed: int | str, *columns: str) -> Column:
    """The order of a seeded shuffle: MD5 of seed and key, equal in any engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]))


def hash_bucket(key: Column) -> Column:
    """4096 buckets in the order of hash_key."""
    return F.substring(key, 1, 3)


def _literal(values: list, kind: str) -> Column:
    """An array of values of a type, also of none."""
    if all(isinstance(v, int | float | str) for v in values):
        return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def _bounds(keys: DataFrame, parts: int) -> list:
    """Up to parts - 1 rising values of the one column, about as many rows apart: quantiles of a number, or of a sample of some 16 rows a part."""
    (name, kind), = keys.dtypes
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        return keys.agg(F.percentile_approx(name, [k / parts for k in range(1, parts)], 10 * parts)).first()[0] or []
    rows = keys.where(F.col(name).isNotNull()).count()
    some = keys.where(F.col(name).isNotNull() & (F.rand(1) * rows < 16 * parts)).orderBy(name).collect()  # a bounded sample
    step = max(1, len(some) // parts)
    return [r[0] for r in some[step::step]][: parts - 1]


def range_bucket(df: DataFrame, key: str, parts: int = 32, source: DataFrame | None = None) -> Column:
    """Up to parts * parts buckets of about as many rows each, in the order of a key, however its values are spread; null keys are in the first.

    The bounds come from one pass over the key alone when the plan is made, so every run of the plan deals alike; `source` is a table with the same keys that is
    cheaper to read than the plan of df. A row finds its bucket in two steps of `parts` comparisons. A key made by in_order needs no bounds: its buckets are
    stretches of files.
    """
    if dict(df.dtypes)[key] == ORDER_TYPE:
        place = F.col(key)
        return F.struct(place["file"], place["block"], F.expr(f"`{key}`.row div {STRETCH}"))
    kind = dict(df.dtypes)[key]
    bounds = _bounds((source or df).select(key), parts**2)
    rows = [bounds[k : k + parts] for k in range(0, len(bounds), parts)] or [[]]
    table = F.array(*[_literal(row, kind) for row in rows])
    lasts = _literal([row[-1] for row in rows[:-1]], kind)
    up_to = lambda values: F.size(F.filter(values, lambda v: v <= F.col(key)))
    return F.when(F.col(key).isNull(), -1).otherwise(up_to(lasts) * parts + up_to(F.get(table, up_to(lasts))))


#: A row's place in the files it was read from: file, start of the split, and row there.
ORDER_TYPE = "struct<file:string,block:bigint,row:bigint>"
#: Rows of a file that are ranked together.
STRETCH = 1 << 16


def in_order(df: DataFrame, name: str = "source_order") -> DataFrame:
    """Adds the place of each row in the files it was read from, which sorts like the files' names and rows. For a table just read, or filtered since.

    Parquet knows its rows' numbers. Of other files, rows are numbered as they are read, in splits that follow each other; such numbers hold for one plan, so a
    table that is read twice should be written to Parquet with them first (`fixed_order`).
    """
    numbered_rows = has_row_index(df)
    row = F.col("_metadata.row_index") if numbered_rows else F.monotonically_increasing_id()
    block = F.lit(0).cast("bigint") if numbered_rows else F.col("_metadata.file_block_start")
    return df.withColumn(name, F.struct(F.col("_metadata.file_path").alias("file"), block.alias("block"), row.alias("row")).cast(ORDER_TYPE))


def has_row_index(df: DataFrame) -> bool:
    """Whether the files that a table is read from know their rows' numbers."""
    try:
        df.select("_metadata.row_index").schema  # noqa: B018 (resolves the name)
    except AnalysisException:
        return False
    return True


def fixed_order(df: DataFrame, name: str = "source_order") -> DataFrame:
    """in_order, with places that stay the same however often the table is read: one of files without row numbers is stored with them."""
    ordered = in_order(df, name)
    if has_row_index(df):
        return ordered
    path = scratch(df.sparkSession, "in-order")
    ordered.write.parquet(path)
    return df.sparkSession.read.schema(ordered.schema).parquet(path)


def numbered(df: DataFrame, bucket: Column, order: list[str | Column], within: tuple[str, ...] = (), name: str = "rank", total: str | None = None) -> DataFrame:
    """Adds `name`, 0, 1, ... in the given order within each value of `within`, and `total`, the number of rows there.

    Buckets must rise with the order. A group's rows spread over its buckets, so a large group is many tasks' work; what
    meets in one task are the counts of a group's buckets.
    """
    taken = [*df.columns, name, total or name]
    own, of, start, rows, rank, count = unused(taken, "bucket", "of", "start", "rows", "place", "count")
    keys = unused([*taken, of], *[f"{c}_of" for c in within])
    keyed = df.withColumn(own, bucket)
    sizes = keyed.groupBy(*[F.col(c).alias(k) for c, k in zip(within, keys, strict=True)], F.col(own).alias(of)).agg(F.count("*").alias(count))
    group = Window.partitionBy(*keys)
    before = group.orderBy(of).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, of, F.coalesce(F.sum(count).over(before), F.lit(0)).alias(start), F.sum(count).over(group).alias(rows))
    same = F.col(own).eqNullSafe(F.col(of))
    for c, k in zip(within, keys, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(k))
    ranked = keyed.withColumn(rank, F.row_number().over(Window.partitionBy(*within, own).orderBy(*order)))
    out = ranked.join(starts, same).withColumn(name, (F.col(start) + F.col(rank) - 1).cast("bigint"))
    if total:
        out = out.withColumn(total, F.col(rows))
    return out.drop(own, of, start, rows, rank, *keys)


#: So many groups at most have their cuts sent to all tasks; more meet their rows in a shuffle.
GROUPS_SENT = 10_000


def first_rows(df: DataFrame, digest: str, tie: str, size: Callable[[Column], Column] | DataFrame, within: tuple[str, ...] = (), name: str = "first") -> DataFrame:
    """Adds `name`: whether a row is among the first of its group in the order of a hash_key, ties by a further column.

    `size` makes their number of the group's number of rows, or is a table of (*within, size), of which rows of other groups are left out. Only buckets are counted: a
    group's cut falls into one of its 4096 buckets, rows of lower buckets are in, of higher ones out, and just that bucket's rows, one in some thousands, are ranked.
    Nothing else is shuffled. The counts are taken when the plan is made.
    """
    taken = [*df.columns, name]
    own, of, start, rows, count, wanted, need = unused(taken, "bucket", "of", "start", "rows", "count", "size", "need")
    keys = unused([*taken, of], *[f"{c}_of" for c in within])
    keyed = df.withColumn(own, hash_bucket(F.col(digest)))
    sizes = keyed.groupBy(*[F.col(c).alias(k) for c, k in zip(within, keys, strict=True)], F.col(own).alias(of)).agg(F.count("*").alias(count))
    group = Window.partitionBy(*keys)
    starts = sizes.select(*keys, of, count, F.coalesce(F.sum(count).over(group.orderBy(of).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(start), F.sum(count).over(group).alias(rows))
    if isinstance(size, DataFrame):
        targets = size.select(*[F.col(c).alias(k) for c, k in zip(within, keys, strict=True)], F.col("size").alias(wanted))
        starts = starts.join(targets, keys)
    else:
        starts = starts.withColumn(wanted, size(F.col(rows)))
    held = F.least(F.col(wanted), F.col(rows))
    cuts = starts.where((F.col(start) < held) & (held <= F.col(start) + F.col(count))).select(*keys, of, (held - F.col(start)).cast("bigint").alias(need))
    small = cuts.limit(GROUPS_SENT + 1).collect()
    if within:
        if len(small) <= GROUPS_SENT:
            cuts = F.broadcast(df.sparkSession.createDataFrame(small, cuts.schema))
        same = F.lit(True)
        for c, k in zip(within, keys, strict=True):
            same = same & F.col(c).eqNullSafe(F.col(k))
        marked = keyed.join(cuts, same, "inner" if isinstance(size, DataFrame) else "left")
    else:  # one group, so one cut, or none in an empty table
        cut = small[0] if small else {of: None, need: None}
        marked = keyed.withColumns({of: F.lit(cut[of]).cast("string"), need: F.lit(cut[need]).cast("bigint")})
    at_cut = F.col(own).eqNullSafe(F.col(of))
    sure = marked.where(~at_cut).withColumn(name, F.coalesce(F.col(own) < F.col(of), F.lit(False)))
    ranked = marked.where(at_cut).withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(digest, tie)) <= F.col(need))
    return sure.unionByName(ranked).drop(own, of, need, *keys)
