"""Large JSON documents as many small ones: the items of an array, or the members of an object, cut apart while the file is read.

A file is read in pieces that end at a closing brace, in as many splits as it has bytes for. Whether a piece begins within a string, and how deep it lies, depends on
all pieces before it. Each split says what it does to both for either beginning; a running sum over the splits tells how each one begins, and so where
the braces are that close an item. The pieces between two of these are an item, put together in a group of its own. No task holds more than
a split and its items, however large the file is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators.scratch import scratch

#: Bytes of stored pieces that a task holds before it writes them.
ROW_GROUP = 16 << 20


def _count(text: Column, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _change(text: Column, quotes: Column, inside: int) -> Column:
    """By how much a piece and its brace change the depth if it begins outside or inside of a string."""
    bare = F.regexp_replace(F.concat(F.lit('"' * inside), text), '(?s)"[^"]*("|$)', "")
    return _count(bare, "{") + _count(bare, "[") - _count(bare, "]") - F.when((quotes + inside) % 2 == 0, 1).otherwise(0)


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, place, value, quotes, outside, inside, before): pieces in order, their quotes, changes of depth, and the quotes before them in their split; stored."""
    read = spark.read.text(path, lineSep="}").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), "value")
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    counted = read.select("*", plain.alias("plain"), _count(plain, '"').alias("quotes"))
    changes = [_change(F.col("plain"), F.col("quotes"), k).alias(n) for k, n in enumerate(("outside", "inside"))]
    earlier = Window.partitionBy("file", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    whole = counted.select("file", "block", "place", "value", "quotes", *changes, F.coalesce(F.sum("quotes").over(earlier), F.lit(0)).alias("before"))
    where = scratch(spark, "json-pieces")
    whole.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(where)
    return spark.read.schema(whole.schema).parquet(where)


def items(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, keyed, place, value): the parts of JSON files in order, each a small JSON document of the file's own shape.

    An array becomes arrays, an object objects, for which `keyed` is true; each holds one item that is an object, and what stands before it that isn't. Joined in
    order, they are the file's. A file that is neither, or holds no object, is one document; a blank file gives none. Files that aren't JSON
    are cut somehow. Items are read from one line or many alike.
    """
    pieces = _pieces(spark, path)
    by_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(by_file), F.lit(0))
    change = lambda inside: F.when((F.col("before") + inside) % 2 == 0, F.col("outside")).otherwise(F.col("inside"))
    splits = pieces.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"), F.sum(change(0)).alias("c0"), F.sum(change(1)).alias("c1"))
    begun = splits.select("file", "block", (so_far("quotes") % 2).alias("inside_at"), "c0", "c1")
    starts = begun.select("file", "block", "inside_at", so_far(F.when(F.col("inside_at") == 0, F.col("c0")).otherwise(F.col("c1"))).alias("depth_at"))

    placed = pieces.join(starts, ["file", "block"])
    upto = Window.partitionBy("file", "block").orderBy("place")
    state = (F.col("before") + F.col("inside_at")) % 2
    moved = placed.select("file", "block", "place", "value", "depth_at", ((state + F.col("quotes")) % 2).alias("within"), F.when(state == 0, F.col("outside")).otherwise(F.col("inside")).alias("change"))
    depth = F.col("depth_at") + F.sum("change").over(upto)
    closed = moved.select("file", "block", "place", "value", ((F.col("within") == 0) & (depth == 1)).alias("closes"))
    number = F.col("closes").cast("long")
    ends = closed.groupBy("file", "block").agg(F.sum(number).alias("n"))
    offsets = ends.select("file", "block", so_far("n").alias("offset"))
    numbered = closed.join(offsets, ["file", "block"]).select("file", "block", "place", "value", "closes", (F.col("offset") + F.sum(number).over(upto) - number).alias("item"))
    whole = numbered.groupBy("file", "item").agg(F.array_sort(F.collect_list(F.struct("block", "place", "value"))).alias("parts"), F.max("closes").alias("closes"))
    text = F.concat(F.array_join(F.transform("parts", lambda p: p["value"]), "}"), F.when(F.col("closes"), "}").otherwise(""))

    kinds = pieces.groupBy("file").agg(F.min_by("value", F.struct("block", "place")).alias("first")).select("file", F.regexp_extract("first", r"^[\uFEFF\s]*(.)", 1).alias("kind"))
    shaped = whole.select("file", "item", "closes", text.alias("text")).join(kinds, "file")
    body = F.regexp_replace("text", F.when(F.col("item") == 0, F.lit(r"^[\uFEFF\s]*[\[{]")).otherwise(F.lit(r"^\s*,")), F.lit(""))
    body = F.when(F.col("closes"), body).when(F.col("kind") == "[", F.regexp_replace(body, r"\]\s*$", "")).otherwise(F.regexp_replace(body, r"\}?\s*$", ""))
    listed, keyed = F.col("kind") == "[", F.col("kind") == "{"
    value = F.when(listed, F.concat(F.lit("["), F.trim(body), F.lit("]"))).when(keyed, F.concat(F.lit("{"), F.trim(body), F.lit("}"))).otherwise(F.col("text"))
    shown = shaped.select(F.col("file").alias("path"), keyed.alias("keyed"), F.col("item").alias("place"), value.alias("value"), F.rlike(body, F.lit(r"\S")).alias("filled"))
    return shown.where(F.col("filled") | (F.col("place") == 0) & F.rlike("value", F.lit(r"\S"))).drop("filled")
