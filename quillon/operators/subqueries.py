"""Scalar subqueries as frames: one row, broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_scalar(df: DataFrame, source: DataFrame, **aggregates: Column) -> DataFrame:
    """``df`` with global aggregates of ``source`` as columns. A global aggregate has exactly one row, which bounds what is broadcast."""
    return df.crossJoin(F.broadcast(source.agg(*[x.alias(n) for n, x in aggregates.items()])))
