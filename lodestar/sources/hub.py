"""Two sources of their own, written against Spark's Python data source interface.

`lodestar_hub` reads data sets by name, subset and split from a root folder, where a hub of data sets would answer: `{root}/{name}/{subset}/{split}` holds
Parquet files (subset `default` if none is named). Its schema is that of the files, or the one that is asked for; its partitions are the files' row groups, of which only
the columns of that schema are read.

`first_lines` reads the first line of each file and nothing more of it.

Both open files through pyarrow's file systems, so their paths may be of any store that pyarrow knows; a path without a scheme is a local one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Files of a partition of first lines, and bytes that are read of a file at a time until its line ends.
FILES, READ_BYTES = 64, 4096
#: Bytes of rows, at most so many, that a reader of a row group holds at a time, and bytes of a column's stored pages.
BATCH_BYTES, BATCH_ROWS, PAGE_BYTES = 4 << 20, 2000, 1 << 20


def opened(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    path = path.replace("file:///", "/").removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _listed(path: str) -> list[str]:
    """The Parquet files below a path, by name."""
    from pyarrow import fs

    system, inside = opened(path)
    found = system.get_file_info(fs.FileSelector(inside, recursive=True, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and f.path.endswith(".parquet"))


@dataclass
class RowGroup(InputPartition):
    path: str
    number: int


class HubReader(DataSourceReader):
    def __init__(self, folder: str, names: list[str]):
        self.folder, self.names = folder, names

    def partitions(self) -> list[RowGroup]:
        import pyarrow.parquet as pq

        system, _ = opened(self.folder)
        out = []
        for path in _listed(self.folder):
            out += [RowGroup(path, k) for k in range(pq.read_metadata(path, filesystem=system).num_row_groups)]
        return out

    def read(self, partition: RowGroup) -> Iterator:
        import pyarrow.parquet as pq

        system, _ = opened(self.folder)
        with pq.ParquetFile(partition.path, filesystem=system, buffer_size=PAGE_BYTES, pre_buffer=False) as file:
            group = file.metadata.row_group(partition.number)
            rows = max(1, min(BATCH_ROWS, BATCH_BYTES * group.num_rows // max(1, group.total_byte_size)))
            yield from file.iter_batches(batch_size=rows, row_groups=[partition.number], columns=self.names, use_threads=False)


class Hub(DataSource):
    """Options: root, name (the format's path also names it), subset, split."""

    @classmethod
    def name(cls) -> str:
        return "lodestar_hub"

    @property
    def folder(self) -> str:
        missing = [k for k in ("root", "name") if not self.options.get(k)]
        if missing:
            raise ValueError(f"options {missing} are missing")
        return "/".join([self.options["root"].rstrip("/"), self.options["name"], self.options.get("subset", "default"), self.options.get("split", "train")])

    def schema(self):
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_schema

        files = _listed(self.folder)
        if not files:
            raise ValueError(f"there is no data set in {self.folder}")
        return from_arrow_schema(pq.read_schema(files[0], filesystem=opened(self.folder)[0]))

    def reader(self, schema) -> HubReader:
        return HubReader(self.folder, schema.fieldNames())


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class FirstLinesReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[Files]:
        return [Files(tuple(self.paths[k : k + FILES])) for k in range(0, len(self.paths), FILES)]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            system, inside = opened(path)
            with system.open_input_file(inside) as file:
                size, line = file.size(), b""
                while len(line) < size and b"\n" not in line:
                    line += file.read(READ_BYTES)
            yield path, line.split(b"\n", 1)[0].decode("utf-8", "replace") if size else None


class FirstLines(DataSource):
    """Option paths: file paths, one a line."""

    @classmethod
    def name(cls) -> str:
        return "first_lines"

    def schema(self) -> str:
        return "path string, value string"

    def reader(self, schema) -> FirstLinesReader:
        return FirstLinesReader([p for p in self.options.get("paths", "").split("\n") if p])


def splits(spark: SparkSession, root: str, name: str, subset: str | None = None, columns: str | None = None) -> dict[str, DataFrame]:
    """The splits of a data set, as lazy tables; `columns` is a schema of those wanted. A data set that isn't there is an error."""
    from pyarrow import fs

    spark.dataSource.register(Hub)
    system, inside = opened(f"{root.rstrip('/')}/{name}/{subset or 'default'}")
    found = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(inside, allow_not_found=True)) if f.type == fs.FileType.Directory)
    if not found:
        raise KeyError(f"no data set {name!r} with subset {subset!r}")
    out = {}
    for split in found:
        options = {"root": root, "name": name, "subset": subset or "default", "split": split}
        # with a schema known here, no worker is started to ask for it
        out[split] = spark.read.format("lodestar_hub").options(**options).schema(columns or Hub(options).schema()).load()
    return out


def first_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, value): the first line of each file, null for an empty one; bytes that aren't UTF-8 are replaced."""
    spark.dataSource.register(FirstLines)
    return spark.read.format("first_lines").option("paths", "\n".join(paths)).load()
