"""Reading files and the places that data sets come from."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.text import base_name, null_if_na
from lodestar.operators.jsonkeys import keys

from . import charsets, hub

def _header(reader, path: str | list[str], name: str) -> list[str]:
    """The decoded column names in the first record; names that are there already, in either case, or empty ones get their place as Spark gives it."""
    first = reader.option("header", False).csv(path).first()
    out: list[str] = []
    for k, cell in enumerate(first or ()):
        text = charsets.decoded_name(cell or "", name)
        text = text or f"_c{k}"
        out.append(f"{text}{k}" if text.lower() in {c.lower() for c in out} else text)
    return out


def csv(spark: SparkSession, path: str | list[str], encoding: str = "utf-8", na: Iterable[str] | None = None, errors: str = "strict") -> DataFrame:
    """A CSV table with a header, all columns text: what is written stays as written.

    Fields and headers may hold line ends; quotes are doubled; a byte order mark is skipped. `na` names texts that count as null, besides
    the empty field. Charsets besides Unicode's, such as cp932, are decoded in the plan, in any session; a cell that isn't of the charset ends the
    job, or with `errors` "replace" gets replacement characters. All files have the columns of the first.
    """
    reader = lambda: spark.read.option("multiLine", True).option("escape", '"').option("inferSchema", False)
    name = charsets.codec(encoding)
    if name is None:
        table = reader().option("header", True).option("encoding", charsets.NATIVE[encoding.lower()]).csv(path)
    else:
        names = _header(reader().option("encoding", charsets.BYTES), path, name)
        schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(names))])
        # with a schema of its own, the reader passes over the header: as bytes, different names may look alike but for case
        raw = reader().option("header", True).option("encoding", charsets.BYTES).schema(schema).csv(path)
        table = raw.select(*[charsets.decoded(F.col(f"c{k}"), name, errors).alias(c) for k, c in enumerate(names)])
    if na is not None:
        table = table.select(*[null_if_na(F.col(f"`{c}`"), na).alias(c) for c in table.columns])
    return table


def documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, value): each file as one text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, value): each line of the files."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def paths(spark: SparkSession, path: str | list[str]) -> list[str]:
    """The files that a path or its pattern names, or that stand in a folder it names, on whatever file system; those whose names begin with a dot or an underscore are none."""
    out = []
    for p in [path] if isinstance(path, str) else path:
        target = spark._jvm.org.apache.hadoop.fs.Path(p)
        system = target.getFileSystem(spark._jsc.hadoopConfiguration())
        found = [g for f in system.globStatus(target) or [] for g in (system.listStatus(f.getPath()) if f.isDirectory() else [f])]
        out += [f.getPath().toString() for f in found if f.isFile() and f.getPath().getName()[0] not in "._"]
    return sorted(out)


#: Stores that the source of first lines opens itself.
OPENED = ("file", "s3", "s3a", "gs", "abfs", "abfss")


def first_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, value): the first line of each file, without its line end; null for a file without lines.

    No more than the beginning of a file is read. Files in a store that only Spark reads are read as lines, in as many splits as Spark makes, and the first line of each
    file's first split is kept.
    """
    found = paths(spark, path)
    if all(p.split(":", 1)[0] in OPENED for p in found):
        lines_ = hub.first_lines(spark, found)
    else:
        rows = spark.read.text(found).select(F.col("_metadata.file_path").alias("path"), "value", F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"))
        first = rows.where("start = 0").groupBy("path").agg(F.min_by("value", "place").alias("value"))
        lines_ = spark.createDataFrame([(p,) for p in found], "path string").join(first, "path", "left")
    return lines_.select("path", F.regexp_replace("value", "\r$", "").alias("value"))


def first_line_keys(spark: SparkSession, path: str | list[str], name: Callable[[Column], Column] = base_name) -> DataFrame:
    """(filename, keys): the top-level keys of the first line of each JSONL file; none for a file without lines. `name` makes the file's name of its path."""
    return first_lines(spark, path).select(name(F.col("path")).alias("filename"), keys(F.col("value")).alias("keys"))


def formats(files) -> str:
    """The one format of files (a path, a list, or a dict of them, at any depth): JSON before Parquet before CSV; JSON for none of these."""

    def names(x):
        if isinstance(x, str):
            yield x.lower()
        elif isinstance(x, Mapping):
            for v in x.values():
                yield from names(v)
        elif x is not None:
            for v in x:
                yield from names(v)

    endings = {n.rsplit(".", 1)[-1] for n in names(files) if "." in n}
    for kind, known in (("json", {"json", "jsonl"}), ("parquet", {"parquet"}), ("csv", {"csv"})):
        if endings & known:
            return kind
    return "json"


def load(spark: SparkSession, files: Mapping[str, str | list[str] | None]) -> dict[str, DataFrame]:
    """A table for each split that has files; all splits are read in the one format of all files."""
    kind = formats(files)
    read = {"json": spark.read.json, "parquet": spark.read.parquet, "csv": lambda p: csv(spark, p)}[kind]
    return {name: (read(path) if kind != "parquet" or isinstance(path, str) else read(*path)) for name, path in files.items() if path}


def chosen_splits(splits: dict[str, DataFrame], train: str | None = "train", val: str | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """The configured splits; None for those that aren't there."""
    return splits.get(train or "train"), splits.get(val) if val else None


def rows(spark: SparkSession, values: list[dict], schema: str) -> DataFrame:
    """A table from row dicts, for small tables of parameters."""
    return spark.createDataFrame(values, schema)


def command_output(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A captured table of columns separated by white space, without its header line (the one that starts with the first column's name)."""
    parts = F.split(F.trim("value"), r"\s+")
    found = spark.read.text(path).where(~F.col("value").startswith(columns[0]) & (F.trim("value") != ""))
    return found.select(*[F.get(parts, F.lit(k)).alias(c) for k, c in enumerate(columns)])


def jobs(table: DataFrame, nodes: list[str] | None = None, user: str | None = None, states: list[str] | None = None) -> DataFrame:
    """The job table filtered by nodes, user and states."""
    for name, wanted in (("node", nodes), ("user", [user] if user else None), ("state", states)):
        if wanted is not None:
            table = table.where(F.col(name).isin(*wanted))
    return table
