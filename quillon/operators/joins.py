"""Joins. Catalyst picks broadcast, shuffle-hash or sort-merge by size; these state what it can't know."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], how: str = "inner", residual: Column | None = None) -> DataFrame:
    """Equi-join on pairs of columns with a residual condition that holds inside the join, before rows are null-extended.

    A NULL key meets nothing. Without keys it is a theta or a cross join.
    """
    on = residual
    for a, b in keys:
        on = left[a] == right[b] if on is None else (left[a] == right[b]) & on
    if on is None:
        return left.crossJoin(right)
    return left.join(right, on, how)


#: Rows, and bytes as text, at most, of a right side that is broadcast whole.
MOST_ROWS, MOST_BYTES = 100_000, 16 << 20


def few(df: DataFrame) -> bool:
    """Whether a broadcast of ``df`` is small, by its rows as they are counted here.

    The planner's guess from the size of files knows neither how well they are packed nor how many rows an ``explode`` makes.
    """
    return df.count() <= MOST_ROWS and (df.select(F.sum(F.octet_length(F.struct("*").cast("string")))).first()[0] or 0) <= MOST_BYTES


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], *, salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where one key may hold a large part of ``left``: its rows are dealt over ``salts`` tasks.

    Both sides are read here to plan the join. A right side that is ``few`` is broadcast. Else both are shuffled, and of
    ``right`` only rows of hot keys are repeated ``salts`` times: keys with over 1 / (4 * salts) of the rows of ``left``, so
    these are under 4 * salts. It is for a right side with few rows per key, for inner and left joins; NULL keys meet nothing.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("the right side's rows are repeated: inner, left, left_semi or left_anti only")
    if few(right):
        return left.join(F.broadcast(right), [*keys], how)
    counts = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    found = counts.filter(F.col("__n") * (4 * salts) > left.count()).drop("__n")
    hot = found.collect()
    if not hot:
        return left.join(right.hint("merge"), [*keys], how)
    # a list, so that both sides agree on what is hot whatever becomes of ``left`` when it is read again
    hot = F.broadcast(left.sparkSession.createDataFrame(hot, found.schema).withColumn("__hot", F.lit(True)))
    named = hot.toDF(*[f"__key{i}" for i in range(len(keys))], "__hot")
    same = [left[k].eqNullSafe(named[f"__key{i}"]) for i, k in enumerate(keys)]
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*[left[c] for c in left.columns]), F.lit(salts))).otherwise(F.lit(0))
    dealt = left.join(named, same, "left").withColumn("__salt", salt.cast("long")).drop("__hot", *[f"__key{i}" for i in range(len(keys))])
    last = F.when(F.col("__hot"), F.lit(salts - 1)).otherwise(F.lit(0)).cast("long")
    repeated = right.join(hot, [*keys], "left").withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("__hot")
    return dealt.join(repeated.hint("merge"), [*keys, "__salt"], how).drop("__salt")
