"""What several operators need: tables in the folder that all executors share, names that are free, and rows in slices for Python workers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Python functions work on about so many characters or bytes of text at a time, whatever the Arrow batch holds.
SLICE_BYTES = 4 << 20
#: Large rows of a stored table that a task holds before it writes them, and that it reads at a time.
LARGE_ROWS = 2


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one in local mode, as in tests; an error on a cluster, whose executors wouldn't share it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own folder, which is deleted when the driver ends."""
    own = f"{shared_folder(spark)}/lodestar/{spark.sparkContext.applicationId}"
    system, target = _file_system(spark, own)
    system.mkdirs(target)
    system.deleteOnExit(target)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, large_rows: bool = False) -> DataFrame:
    """The rows of df, written to the shared folder and read again: later steps don't compute them twice, and a lost executor costs no more than a reread.

    `large_rows`: rows have some MB each. A writer holds, and a reader takes together, a row group's rows (up to 4,096), whose size is looked at after a hundred rows and
    counts what is compressed; so row groups have a few rows.
    """
    path = new_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if large_rows:
        writer = writer.option("parquet.block.row.count.limit", LARGE_ROWS)
    writer.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def release(*tables: DataFrame) -> None:
    """Deletes stored tables that no later step reads."""
    for table in tables:
        system, target = _file_system(table.sparkSession, table.stored_at)
        system.delete(target, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until no column of df is called so, in either case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def columns(batch, *names):
    """The named columns of an Arrow batch as Python lists."""
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def sliced(lengths, most: int = SLICE_BYTES, rows: int = 1000):
    """(start, stop) of neighbouring rows that hold about `most` bytes and at most `rows` rows; a longer row is alone."""
    start = held = 0
    for k, n in enumerate(lengths):
        if k > start and (held + n > most or k - start >= rows):
            yield start, k
            start, held = k, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def batch_slices(batch, *texts: str):
    """An Arrow batch in slices by the bytes of its string or binary columns `texts`."""
    import pyarrow.compute as pc

    sizes = [pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(t))), 0).to_pylist() for t in texts]
    for start, stop in sliced([sum(x) for x in zip(*sizes, strict=True)]):
        yield batch.slice(start, stop - start)


def series_slices(batches):
    """pandas series of texts or bytes in slices by their lengths."""
    for values in batches:
        for start, stop in sliced([len(v) if v is not None else 0 for v in values]):
            yield values.iloc[start:stop]


def iterator_udf(function, kind, arguments: int = 1):
    """A scalar iterator pandas UDF; it names the types that annotations postponed by __future__ can't carry."""
    from collections.abc import Iterator

    import pandas as pd
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    whole = isinstance(kind, str) and "," in kind or isinstance(kind, T.StructType)
    taken = pd.Series if arguments == 1 else tuple[(pd.Series,) * arguments]
    function.__annotations__ = {"batches": Iterator[taken], "return": Iterator[pd.DataFrame if whole else pd.Series]}
    return F.pandas_udf(function, kind)
