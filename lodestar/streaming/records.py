"""The row-wise conversion over files as they arrive: the same expressions, without splits, which need the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.plans.convert import unified
from lodestar.plans.infer import Config


def json_stream(spark: SparkSession, folder: str, schema: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(folder)


def unified_stream(rows: DataFrame, config: Config, index: str) -> DataFrame:
    """Unified records of a stream; all are `train`, numbered by a column of the source."""
    return unified(rows.withColumns({"split": F.lit("train"), "index": F.col(index)}), config)


def caught_up(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Writes what has arrived since the last call with the same checkpoint, waits for it, and gives all that was ever written; each record is there once, also after a stop halfway."""
    written(stream, path, checkpoint).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def written(stream: DataFrame, path: str, checkpoint: str):
    """Starts a query that writes what has arrived to Parquet, once, and ends; run it again for what comes later."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
