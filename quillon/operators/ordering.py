"""Order and limits; NULLs come first, ascending or descending."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sort_keys(*keys: str) -> list[Column]:
    """``name`` ascending, ``-name`` descending."""
    return [F.col(k[1:]).desc_nulls_first() if k.startswith("-") else F.col(k).asc_nulls_first() for k in keys]


def order(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*sort_keys(*keys))


def top_k(df: DataFrame, keys: Sequence[str], k: int, *, skip: int = 0) -> DataFrame:
    """The first ``k`` rows after ``skip``: each task keeps its own first rows, no full sort is made."""
    ordered = order(df, *keys)
    return ordered.limit(k) if not skip else ordered.offset(skip).limit(k)
