"""Writing tables."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.jsonkeys import padded

from . import charsets


def parquet(df: DataFrame, path: str, codec: str = "snappy") -> str:
    df.write.mode("overwrite").option("compression", codec).parquet(path)
    return path


def split_parquet(df: DataFrame, folder: str, prefix: str, names: tuple[str, ...] = ("train", "val")) -> list[str]:
    """Paths `{folder}/{prefix}/split=train` and `split=val`, written in one pass, without the split column; a split without rows is an empty table.

    A row of any other split, null included, ends the job: nothing is left out.
    """
    top = f"{folder}/{prefix}"
    known = F.coalesce(F.col("split").isin(*names), F.lit(False))
    other = F.raise_error(F.concat(F.lit("no such split: "), F.coalesce(F.col("split").cast("string"), F.lit("null")))).cast("string")
    df.withColumn("split", F.when(known, F.col("split")).otherwise(other)).write.mode("overwrite").option("compression", "snappy").partitionBy("split").parquet(top)
    paths = [f"{top}/split={s}" for s in names]
    for path in paths:
        system, target = _file_system(df, path)
        if not system.exists(target):
            parquet(df.drop("split").limit(0), path)
    return paths


def _csv(df: DataFrame, path: str, encoding: str = "utf-8") -> str:
    name = charsets.codec(encoding)
    if name is None:
        charset = charsets.NATIVE[encoding.lower()]
    else:
        charset = charsets.BYTES
        df = df.select(*[charsets.encoded(F.col(f"`{c}`").cast("string"), name).alias(charsets.encoded_name(c, name)) for c in df.columns])
    writer = df.write.mode("overwrite").option("encoding", charset).option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "")
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def csv(df: DataFrame, path: str, fields: list[str] | None = None, encoding: str = "utf-8") -> str:
    """CSV with a header; quotes are doubled, spaces kept, nulls empty; `fields` choose and order the columns. Every part file has the header.

    A text that the charset can't express ends the job.
    """
    return _csv(df.select(*fields) if fields else df, path, encoding)


def csv_with_mark(df: DataFrame, path: str) -> str:
    """CSV files that each start with a header and a byte order mark, for spreadsheets; a table of one partition is one file."""
    first = df.columns[0]
    return _csv(df.withColumnRenamed(first, "\ufeff" + first), path)


def key_table(df: DataFrame, path: str) -> str:
    """(filename, keys) as CSV with columns key1, key2, ..."""
    return _csv(padded(df, "keys"), path)


def writable(df: DataFrame) -> Column:
    """Whether a row can be written as text: none of its string columns holds bytes that aren't UTF-8."""
    ok = F.lit(True)
    for c, kind in df.dtypes:
        if kind == "string":
            ok = ok & F.coalesce(F.is_valid_utf8(F.col(f"`{c}`")), F.lit(True))
    return ok


def jsonl(df: DataFrame, path: str, rows: int | None = None, order: str | None = None, skipped: str | None = None) -> str:
    """One JSON object a line, nulls kept, other scripts as they are; with `rows`, the first so many in an order.

    Rows that can't be written as text are left out, and with `skipped` go to Parquet there, so that they can be counted and mended.
    """
    if rows is not None:
        df = df.orderBy(order).limit(rows) if order else df.limit(rows)
    ok = writable(df)
    df.where(ok).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
    if skipped:
        parquet(df.where(~ok), skipped)
    return path


def report(df: DataFrame, path: str) -> str:
    """Lines of text, from (value)."""
    df.select("value").write.mode("overwrite").text(path)
    return path


def pretty(df: DataFrame) -> DataFrame:
    """(value): each row as indented JSON, for a look at a few."""
    return df.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("value"))


def _file_system(df: DataFrame, path: str):
    target = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()), target


def size_mb(df: DataFrame, path: str) -> float:
    """Megabytes of the files under a path, on whatever file system it names."""
    system, target = _file_system(df, path)
    return system.getContentSummary(target).getLength() / 1e6


def logger(name: str, file: str | None = None) -> logging.Logger:
    """Logs with times to the console, and to a file of the driver if one is named."""
    log = logging.getLogger(name)
    if not log.handlers:
        for handler in [logging.StreamHandler(), *([logging.FileHandler(file)] if file else [])]:
            handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
            log.addHandler(handler)
        log.setLevel(logging.INFO)
    return log
