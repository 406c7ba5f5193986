"""Slices, free names and stored tables."""

import os

import pyarrow as pa
import pytest

from lodestar.llm import shared


def test_slices_cover_all_rows_in_order():
    lengths = [5, 1, 1, 9, 0, 0, 3]
    found = list(shared.sliced(lengths, most=7, rows=3))
    assert [k for a, b in found for k in range(a, b)] == list(range(7)) and found == [(0, 3), (3, 4), (4, 7)]
    assert list(shared.sliced([])) == [] and list(shared.sliced([10**9])) == [(0, 1)]
    batch = pa.RecordBatch.from_pydict({"text": ["é" * 3, None, "x" * (shared.SLICE_BYTES + 1), ""]})
    assert [part.num_rows for part in shared.batch_slices(batch, "text")] == [2, 1, 1]


def test_names_that_are_free(spark):
    df = spark.createDataFrame([(1, 2)], "Key int, _key int")
    assert shared.unused(df, "key", "row", "row") == ["__key", "row", "_row"]


def test_stored_tables_can_be_released(spark):
    table = shared.stored(spark.range(5), "some")
    assert table.count() == 5 and os.path.isdir(table.stored_at.removeprefix("file://"))
    shared.release(table)
    assert not os.path.exists(table.stored_at.removeprefix("file://"))


def test_large_rows_are_stored_a_few_at_a_time(spark):
    """A reader takes a row group's rows together."""
    import pyarrow.parquet as pq

    large = spark.range(60).repartition(1).selectExpr("id", "cast(repeat(uuid(), 60000) AS binary) AS content")  # 2 MB a row
    table = shared.stored(large, "large", large_rows=True)
    folder = table.stored_at.removeprefix("file://")
    groups = [part.metadata.row_group(k).num_rows for part in (pq.ParquetFile(f"{folder}/{f}") for f in os.listdir(folder) if f.endswith(".parquet")) for k in range(part.num_row_groups)]
    assert sum(groups) == 60 and max(groups) <= shared.LARGE_ROWS
    assert table.agg({"id": "sum"}).first()[0] == 1770


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        shared.shared_folder(Session())
