"""Sharding by a hierarchical weighted hash tree: regions hold racks, racks hold shards.

A key descends the tree. At each node every child draws -ln(u) / weight, where u is a hash of the key and the child's
name in (0, 1); the smallest draw wins. Such draws are exponential with the child's weight as rate, so children
win in proportion to their weights, and raising one child's weight, or adding a child, only moves keys into
that child: movement stays within the subtrees whose weights changed. A shard in a new region of its own therefore takes
keys from the others and moves none between them.

Everything is column expressions: no row depends on another, except for the slots, which number a shard's rows
without gaps through counts of hash buckets and never gather a shard in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import unused

#: Rows that share a numbering task, about.
SLOT_ROWS = 50_000


@dataclass(frozen=True)
class Tree:
    """regions[r][k] is the rack k of region r: a tuple of (shard number, weight)."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @staticmethod
    def balanced(shards: int, per_rack: int = 2, racks: int = 2) -> Tree:
        """Equal shards, filled rack by rack and region by region."""
        numbers = [(s, 1.0) for s in range(shards)]
        all_racks = [tuple(numbers[k : k + per_rack]) for k in range(0, shards, per_rack)]
        return Tree(tuple(tuple(all_racks[k : k + racks]) for k in range(0, len(all_racks), racks)))

    def with_region(self, shard: int, weight: float = 1.0) -> Tree:
        """The tree with one more shard, in a region of its own."""
        return Tree((*self.regions, (((shard, weight),),)))


def _smallest_draw(key: Column, level: str, names: Column, weights: Column) -> Column:
    """The place of the winning child: names and weights are arrays alike."""

    def draw(child, at):
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), child["names"]), 11)
        return F.struct(F.try_divide(-F.log((bits + 0.5) / float(1 << 53)), child["weights"]).alias("draw"), at.alias("at"))

    children = F.arrays_zip(names.alias("names"), weights.alias("weights"))
    return F.array_min(F.filter(F.transform(children, draw), lambda d: d["draw"].isNotNull()))["at"]


def _literal(rows, kind: str) -> Column:
    return F.from_json(F.lit(str([list(r) if isinstance(r, (list, tuple)) else r for r in rows]).replace("'", '"')), kind)


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of a key. A null key is a key like another; children without weight are never chosen."""
    region_weights = [sum(w for rack in region for _, w in rack) for region in tree.regions]
    region = _smallest_draw(key, "region", F.sequence(F.lit(0), F.lit(len(tree.regions) - 1)), _literal(region_weights, "array<double>"))
    rack_names = [[f"{r}/{k}" for k in range(len(racks))] for r, racks in enumerate(tree.regions)]
    rack_weights = [[sum(w for _, w in rack) for rack in racks] for racks in tree.regions]
    names = [[[s for s, _ in rack] for rack in racks] for racks in tree.regions]
    weights = [[[w for _, w in rack] for rack in racks] for racks in tree.regions]

    def in_region(r):
        rack = _smallest_draw(key, "rack", F.get(_literal(rack_names, "array<array<string>>"), r), F.get(_literal(rack_weights, "array<array<double>>"), r))
        own = F.transform(F.array(rack), lambda k: F.struct(F.get(F.get(_literal(names, "array<array<array<int>>>"), r), k).alias("n"), F.get(F.get(_literal(weights, "array<array<array<double>>>"), r), k).alias("w")))
        return F.get(F.transform(own, lambda x: F.get(x["n"], _smallest_draw(key, "shard", x["n"], x["w"]))), F.lit(0))

    return F.get(F.transform(F.array(region), in_region), F.lit(0)).cast("int")


def numbered(df: DataFrame, group: str, key: str, spread: str, slot: str = "slot") -> DataFrame:
    """Adds `slot`: 0, 1, ... without gaps within each value of `group`, in the order of hash buckets, then keys, then the values of `spread`.

    A bucket holds about SLOT_ROWS rows of different key or `spread`; rows alike in both are interchangeable and share one.
    """
    bucket, rows, of, at, start, rank = unused(df, "bucket", "rows", "of", "at", "start", "rank")
    buckets = max(1, df.count() // SLOT_ROWS)
    placed = df.withColumn(bucket, F.pmod(F.xxhash64(F.col(key), F.col(spread), F.lit("slot")), F.lit(buckets)))
    sizes = placed.groupBy(F.col(group).alias(of), F.col(bucket).alias(at)).agg(F.count("*").alias(rows))
    before = Window.partitionBy(of).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(of, at, F.coalesce(F.sum(rows).over(before), F.lit(0)).alias(start))
    ranked = placed.withColumn(rank, F.row_number().over(Window.partitionBy(group, bucket).orderBy(key, spread)))
    joined = ranked.join(starts, F.col(group).eqNullSafe(F.col(of)) & (F.col(bucket) == F.col(at)))
    return joined.withColumn(slot, (F.col(start) + F.col(rank) - 1).cast("long")).drop(bucket, of, at, start, rank)


def assign(df: DataFrame, tree: Tree, grown: Tree, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each input row: the key, its size and checksum, and its shard, slot and shard in the grown tree.

    The size is the text's UTF-8 bytes (null: none) plus 1. Only key and text are read, so other columns can't clash. An empty table gives no rows;
    rows with equal keys, null ones too, go to the same shard with slots of their own, which are dealt by key and text.
    """
    encoded = F.coalesce(F.encode(F.col(text), "utf-8"), F.lit(b""))
    rows = df.select(
        F.col(key),
        (F.length(encoded) + 1).cast("long").alias("size"),
        F.crc32(encoded).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col(key), tree).alias("shard"),
        shard_of(F.col(key), grown).alias("grown_shard"),
    )
    return numbered(rows, "shard", key, "text_crc32").select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
