"""Scalar functions whose results differ from Spark's defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon import types as Q


def divide(df: DataFrame, one: str, two: str) -> Column:
    """``one / two`` with the type of its operands: whole numbers give whole numbers."""
    a, b = df.schema[one].dataType, df.schema[two].dataType
    if Q.is_whole(a) and Q.is_whole(b):
        return F.expr(f"CAST(`{one}` DIV `{two}` AS {Q.wider_whole(a, b).simpleString()})")
    return df[one] / df[two]


def date_plus(date: Column, interval: str, *, minus: bool = False) -> Column:
    """A date and an interval such as ``1 month`` give a date, also where hours are added."""
    n, unit = interval.split()
    step = F.expr(f"INTERVAL '{int(n)}' {unit.upper().removesuffix('S')}")
    return ((date - step) if minus else (date + step)).cast("date")


__all__ = ["date_plus", "divide"]
