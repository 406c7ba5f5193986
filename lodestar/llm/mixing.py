"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source of n rows that is to give a share w of N rows has the repetition rate N * w / n. Each of its rows is
repeated as often as a Poisson variable of that mean says, which is drawn by inverting the distribution at a number that is a
hash of the seed and the row's key. So every row is decided alone, equal keys alike, and rates may be above or
below one. The copies are then shuffled globally: they go to partitions by a hash and are sorted by it there.

The distribution functions are computed once for each source, in a table that is stored; Spark broadcasts it if it is under its
threshold, and joins by shuffle otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored, unused

#: A Poisson variable of a larger mean is summed from several of equal means, as e^-mean would vanish.
PIECE = 200.0


def hashed(*parts: Column) -> Column:
    """A whole number from 0 to 2^52 - 1 from the parts, null ones as `null`."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def _distribution(mean: Column) -> Column:
    """Values of the Poisson distribution function at 0, 1, ... as far as a number of 52 bits can reach."""
    last = (mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.array(F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c")))

    def step(so_far, k):
        last = F.element_at(so_far, -1)
        p = last["p"] * mean / k
        return F.concat(so_far, F.array(F.struct(p.alias("p"), (last["c"] + p).alias("c"))))

    return F.transform(F.aggregate(F.sequence(F.lit(1), last), start, step), lambda x: x["c"])


def temperature_weights(sizes: DataFrame, power: float) -> DataFrame:
    """Target weights (source, weight) from sizes (source, n): n to a power; under 1, small sources gain."""
    return sizes.select("source", F.pow(F.col("n").cast("double"), F.lit(power)).alias("weight"))


def source_sizes(df: DataFrame, source: str = "source") -> DataFrame:
    return df.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"))


def repetition_rates(sizes: DataFrame, weights: DataFrame, rows: float | None = None) -> DataFrame:
    """(source, rate) from sizes (source, n) and weights (source, weight).

    `rows` is the expected size of the mix; None: that of the input. Weights need not sum to 1. A null source is a source of its own. Sources without a weight,
    or with a null or negative one, get rate 0; weights of sources without rows count for nothing.
    """
    named = weights.select(F.col("source").alias("_source"), F.col("weight").alias("_weight"))
    both = sizes.join(named, F.col("source").eqNullSafe(F.col("_source")), "left").select("source", "n", F.greatest(F.coalesce(F.col("_weight"), F.lit(0.0)), F.lit(0.0)).alias("weight"))
    total = both.agg(F.sum("n").cast("double").alias("rows"), F.sum("weight").alias("weights")).first()  # one row
    wanted = float(total["rows"] or 0) if rows is None else float(rows)
    share = F.col("weight") / (total["weights"] or 1.0)
    return both.select("source", (F.lit(wanted) * share / F.col("n")).alias("rate"))


def replicate(df: DataFrame, rates: DataFrame, key: str = "doc_id", source: str = "source", seed: str = "mix", copy: str = "copy", order: str = "mix_key") -> DataFrame:
    """Every row as often as its Poisson count says, with `copy` (0, 1, ...) and `order` (the global shuffle's sort key), shuffled.

    Rows of a source that `rates` doesn't name are not taken. Rows with equal keys get equal counts. An empty table gives an empty one.
    Columns called like the two new ones are replaced.
    """
    of_source, pieces, cdf, count = unused(df, "of_source", "pieces", "cdf", "count")
    parts = F.greatest(F.ceil(F.col("rate") / PIECE), F.lit(1)).cast("int")
    table = rates.where("rate > 0").select(F.col("source").alias(of_source), parts.alias(pieces), _distribution(F.col("rate") / parts).alias(cdf))
    table = stored(table, "mixing-rates")
    joined = df.drop(copy, order).join(table, F.col(source).eqNullSafe(F.col(of_source)))
    seeded = F.lit(seed)

    def drawn(piece):
        u = (hashed(seeded, F.col(key), piece) + 0.5) / float(1 << 52)
        return F.get(F.transform(F.array(u), lambda v: F.size(F.filter(F.col(cdf), lambda c: c <= v))), F.lit(0))

    times = F.aggregate(F.sequence(F.lit(1), F.col(pieces)), F.lit(0), lambda total, piece: total + drawn(piece))
    counted = joined.withColumn(count, times).where(F.col(count) > 0).drop(of_source, pieces, cdf)
    copies = counted.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(count) - 1))).drop(count)
    keyed = copies.withColumn(order, hashed(F.concat(seeded, F.lit("-order")), F.col(key), F.col(copy)))
    return keyed.repartition(order).sortWithinPartitions(order, key, copy)
