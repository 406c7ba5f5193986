"""Text of cluster tools as tables: node lists, accelerators, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def expanded_nodes(df: DataFrame, nodes: str, name: str = "node", rank: str = "node_rank") -> DataFrame:
    """A row for each node of `prefix[84-86,9]`, numbers of two digits at least, with its place in the list; no bracket, no rows."""
    prefix = F.regexp_extract(nodes, r"^([^\[]*)", 1)
    body = F.regexp_extract(nodes, r"\[([^\]]+)", 1)
    part = lambda x, k: F.try_element_at(F.split(x, "-"), F.lit(k)).cast("int")
    numbers = F.flatten(F.transform(F.split(body, ","), lambda x: F.when(part(x, 1) <= F.coalesce(part(x, 2), part(x, 1)), F.sequence(part(x, 1), F.coalesce(part(x, 2), part(x, 1)))).otherwise(F.array().cast("array<int>"))))
    rows = df.where(body != "").select(*df.columns, prefix.alias("_prefix"), F.posexplode(numbers).alias(rank, "_number"))
    return rows.withColumn(name, F.format_string("%s%02d", "_prefix", "_number")).drop("_prefix", "_number")


def accelerators(df: DataFrame, node: str = "NODE", gres: str = "GRES", used: str = "GRES_USED") -> DataFrame:
    """(NODE, TOTAL, USED, FREE, STATE): third fields of `gpu:X:8`; no total counts as 0, and all free is idle."""
    third = lambda c: F.coalesce(F.regexp_extract(F.get(F.split(c, ":"), F.lit(2)), r"^(\d+)", 1), F.lit(""))
    number = lambda c: F.when(third(c) == "", 0).otherwise(third(c).try_cast("int"))
    # a total with more than digits is compared as text, which never equals what is free
    exact = F.coalesce(F.rlike(F.get(F.split(gres, ":"), F.lit(2)), F.lit(r"^\d*$")), F.lit(True))
    counted = df.select(F.col(node).alias("NODE"), number(gres).alias("TOTAL"), number(used).alias("USED"), exact.alias("_exact"))
    counted = counted.withColumn("FREE", F.col("TOTAL") - F.col("USED"))
    state = F.when(F.col("_exact") & (F.col("FREE") == F.col("TOTAL")), "idle").when(F.col("FREE") > 0, "mix").otherwise("alloc")
    return counted.withColumn("STATE", state).drop("_exact")


def report_lines(df: DataFrame) -> DataFrame:
    """(value): fixed-width text lines of accelerators()."""
    return df.select(F.format_string("%-20s %-10d %-10d %-10d %s", "NODE", "TOTAL", "USED", "FREE", "STATE").alias("value"))


def job_list(running: DataFrame, pending: DataFrame) -> DataFrame:
    """Jobs on the nodes, then the pending ones without repetition; repetitions across the two stay."""
    return running.unionByName(pending.distinct())


def valid_nodes(names: list[str], allowed: list[str], prefix: str = "") -> list[str]:
    wrong = [n for n in names if n not in allowed]
    if wrong:
        raise ValueError(f"unknown nodes {wrong}; allowed are {allowed}")
    return [prefix + n for n in names]


def port(user: Column, base: int = 8800) -> Column:
    """A port from the last two digits of a user name."""
    return F.right(user, F.lit(2)).cast("int") + base
