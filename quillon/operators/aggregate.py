"""Aggregation: partial on the map side and final after one shuffle; NULL is a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aggregate(df: DataFrame, groups: Sequence[str | Column], **measures: Column) -> DataFrame:
    """The measures by group, or over all rows (one row, also of no input) without groups."""
    named = [x.alias(n) for n, x in measures.items()]
    return df.groupBy(*groups).agg(*named) if groups else df.agg(*named)


def count_distinct_by(df: DataFrame, groups: Sequence[str], value: str, name: str) -> DataFrame:
    """Distinct non-null values by group: first by group and value, so that a hot group is dealt by its values, then by group."""
    pairs = df.groupBy(*groups, value).agg(F.lit(1).alias("__one"))
    return pairs.groupBy(*groups).agg(F.count(value).alias(name))


def distinct(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()
