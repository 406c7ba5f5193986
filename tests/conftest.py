import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    import os

    os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # for Python workers
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    # a plain session: no result may depend on settings
    made = SparkSession.builder.appName("tests").config(map={"spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{shared}"}).getOrCreate()
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
