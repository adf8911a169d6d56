"""What Catalyst made of a frame; nothing here runs a job."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def plan_texts(df: DataFrame) -> tuple[str, str, str]:
    """The analyzed, the optimized and the physical plan."""
    execution = df._jdf.queryExecution()
    return execution.analyzed().toString(), execution.optimizedPlan().toString(), execution.executedPlan().toString()


def pushed_filters(df: DataFrame) -> list[str]:
    """The filters that reach the scans."""
    return re.findall(r"PushedFilters: \[(.*?)\]", plan_texts(df)[2])


def read_columns(df: DataFrame) -> list[set[str]]:
    """The columns that each scan reads."""
    return [set(re.findall(r"(\w+):", s)) for s in re.findall(r"ReadSchema: struct<(.*?)>", plan_texts(df)[2])]
