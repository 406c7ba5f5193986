"""Connected components of a graph given as a table of edges, by alternating large and small stars.

Each round links every node's larger neighbours, then its smaller ones, to the smallest node it knows; the number of
rounds grows with the logarithm of the graph's size. Every round is stored, and only a count and a checksum of its edges come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (u, v) with u > v."""
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    joined = around.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b), whose ids have one orderable type: the component's smallest node. No edges, no rows; loops and repeated edges count for nothing."""
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components-edges")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
        edges = stored(_star(_star(edges, True), False), "components-edges")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
