"""One Spark session for all tests, in folders of their own."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = tmp_path_factory.mktemp("spark")
    conf = {
        "spark.master": "local[8]", "spark.driver.memory": "6g", "spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": f"file://{root}/warehouse", "spark.checkpoint.dir": f"file://{root}/shared",
    }
    session = SparkSession.builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
