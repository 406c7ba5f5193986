"""Session settings and table loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Settings for speed and plain times; no result of an operator depends on them but times as text.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(app: str = "lodestar", **settings: str) -> SparkSession:
    """A session with SETTINGS; further settings may use `_` for `.` in their names."""
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | {k.replace("_", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of a folder, on whatever file system the path names."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
