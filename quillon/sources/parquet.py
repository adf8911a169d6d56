"""Parquet tables: the scan prunes columns and takes the filters that Catalyst pushes down."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of a folder of Parquet tables; read by Spark alone, so any path that Spark knows will do."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
