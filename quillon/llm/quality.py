"""Quality rules with adaptive thresholds.

Each text gets a few integer measures. Their distribution in each language and source is held in a mergeable quantile
sketch, and the thresholds are fences read from the sketches instead of fixed cutoffs: a high quantile, and beyond it a
multiple of its distance from the median. The sketch is a histogram whose buckets keep the seven leading bits of a value
(relative error under 1/64): sketches merge by adding counts, so they are built by partial aggregation, a hot source
included. The fences of a group are drawn towards those of its language, and these towards those of all rows, with the
weight of PRIOR rows, so that a small group has no wild fences and a large one its own. The fences are joined to the
rows again for the verdict. Rows that fail the base rule are out already and not in the sketches.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quillon.llm.common import col, map_arrow, nested, small_side, stored, unnested

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: What the fences of the coarser group weigh, in rows.
PRIOR = 50
#: Measures: name, upper quantile in percent, lower one (None: no lower fence), and how many times its distance from the
#: median (one unit at least) the fence lies beyond the quantile. Values are per mille, or hundredths of a character.
MEASURES = (("symbols", 90, None, 3), ("repeats", 99, None, 1), ("dup_lines", 99, None, 1), ("word_len", 75, 25, 6))

BASE = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")])
_POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def measure_text(raw: bytes | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and lines with a word, of one whole text in UTF-8."""
    if not raw:
        return 0, 0, 0, 0, 0, 0
    words = raw.split()
    if not words:
        return 0, 0, 0, 0, 0, 0  # white space alone: no symbol either
    chars = len(b"".join(words).decode("utf-8", "replace"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words), len(lines)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more.

    Hashes find the windows that may repeat; those are then compared word by word, so the count is exact.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for i in range(window):
        mixed += hashes[i : n + i] * _POWERS[i % 8]
    order = np.argsort(mixed)
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    at = np.flatnonzero(maybe).tolist()
    found = Counter(keys := [tuple(words[i : i + window]) for i in at])
    starts = np.zeros(len(words) + 1, np.int64)
    for i, key in zip(at, keys, strict=True):
        if found[key] > 1:
            starts[i] += 1
            starts[i + window] -= 1
    return int((np.cumsum(starts) > 0).sum())


def measured(slim: DataFrame) -> DataFrame:
    """All columns of ``slim`` but ``body`` (a text in UTF-8), and the base measures of that; a null text has no words."""
    keep = [c for c in slim.columns if c != "body"]
    schema = T.StructType([slim.schema[c] for c in keep] + BASE.fields)

    def run(rows: dict[str, list]) -> dict[str, list]:
        found = [measure_text(x) for x in rows["body"]]
        return {n: [x[i] for x in found] for i, n in enumerate(BASE.names)}

    return map_arrow(slim, run, schema, carry=keep)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def measure_columns() -> dict[str, Column]:
    """The integer measures that have sketches."""
    per = lambda x, y: F.expr(f"{x} * 1000 div greatest({y}, 1)")
    return {"symbols": per("n_symbols", "n_words"), "repeats": per("n_repeat_words", "n_words"), "dup_lines": per("n_dup_lines", "n_lines"), "word_len": F.expr("word_chars * 100 div greatest(n_words, 1)")}


def bucket(value: Column) -> Column:
    """The sketch's bucket of a non-negative integer: its seven leading bits, the rest zero."""
    drop = F.greatest(F.length(F.bin(value)) - 7, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketches(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Mergeable quantile sketches: rows (groups..., measure, value, n), by partial aggregation."""
    stacked = F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), bucket(x).alias("value")) for name, x in measure_columns().items()]))
    return rows.select(*groups, stacked.alias("m")).groupBy(*groups, "m.measure", "m.value").agg(F.count(F.lit(1)).alias("n"))


def merged(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """The sketches of coarser groups: counts add up."""
    return sketch.groupBy(*groups, "measure", "value").agg(F.sum("n").alias("n"))


def _of_measure(at: int) -> Column:
    """What MEASURES holds at a position, for the row's measure."""
    return F.coalesce(*[F.when(F.col("measure") == m[0], F.lit(m[at])) for m in MEASURES])


def own_fences(sketch: DataFrame, groups: list[str]) -> DataFrame:
    """Rows, lower and upper fence of each sketch by itself (a sketch has a few hundred buckets at most)."""
    by = W.partitionBy(*groups, "measure")
    ranked = sketch.withColumn("upto", F.sum("n").over(by.orderBy("value").rowsBetween(W.unboundedPreceding, 0))).withColumn("rows", F.sum("n").over(by))
    at = lambda percent: F.min(F.when(F.col("upto") * 100 >= F.col("rows") * percent, F.col("value")))
    found = ranked.groupBy(*groups, "measure").agg(F.max("rows").alias("rows"), at(_of_measure(2)).alias("down"), at(F.lit(50)).alias("middle"), at(_of_measure(1)).alias("up"))
    reach = lambda x: _of_measure(3) * F.greatest(x, F.lit(1))
    low, high = F.col("down") - reach(F.col("middle") - F.col("down")), F.col("up") + reach(F.col("up") - F.col("middle"))
    return found.select(*groups, "measure", "rows", low.alias("low"), high.alias("high"))


def fences(sketch: DataFrame) -> DataFrame:
    """Lower and upper fence per language, source and measure, drawn towards those of the language and of all rows.

    ``sketch`` is by ``lang`` and ``source``. All inputs here have one row per group, measure and bucket.
    """
    named = lambda df, p: df.select(*[F.col(c).alias(p + c) for c in df.columns])
    own, by_lang, all_rows = own_fences(sketch, ["lang", "source"]), named(own_fences(merged(sketch, ["lang"]), ["lang"]), "l_"), named(own_fences(merged(sketch, []), []), "a_")
    both = own.join(by_lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("measure") == F.col("l_measure")))
    both = both.join(F.broadcast(all_rows), F.col("measure") == F.col("a_measure"))  # one row per measure
    drawn = lambda x, rows, to: (F.col(x) * F.col(rows) + to * PRIOR) / (F.col(rows) + PRIOR)
    blend = lambda x: drawn(x, "rows", drawn(f"l_{x}", "l_rows", F.col(f"a_{x}")))
    return both.select("lang", "source", "measure", blend("low").alias("low"), blend("high").alias("high"))


def limits(rows: DataFrame) -> DataFrame:
    """One row (``l``, ``s``, ``limits``: measure to fences) per ``lang`` and ``source`` of measured rows."""
    sketch = stored(sketches(rows.filter(~base_failed()), ["lang", "source"]))
    fence = F.struct("measure", F.struct("low", "high").alias("x"))
    # a group has one row per measure, so the list is short
    by_group = fences(sketch).groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(fence)).alias("limits"))
    return by_group.select(F.col("lang").alias("l"), F.col("source").alias("s"), "limits")


def verdicts(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Measured rows with ``failed`` (the base rule) and ``stays``, by a join with their group's fences."""
    joined = rows.join(small_side(stored(found)), F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    bad = F.lit(False)
    for name, x in measure_columns().items():
        fence = F.col("limits")[name]
        bad = bad | F.coalesce(bucket(x) < fence["low"], F.lit(False)) | F.coalesce(bucket(x) > fence["high"], F.lit(False))
    return joined.withColumns({"failed": base_failed(), "stays": ~base_failed() & ~bad}).drop("l", "s", "limits")


def _slim(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> dict[str, Column]:
    return {"lang": col(docs, lang_col), "source": col(docs, source_col), "body": col(docs, text_col).cast("binary")}


def judged(docs: DataFrame, key: str = "doc_id", *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``key``, the base measures, base_failed and kept for every row of ``docs``.

    A null or empty text has no words and fails; null languages and sources are groups of their own; equal rows get equal
    verdicts; an empty table gives an empty result. Other columns of ``docs`` may have any name.
    """
    rows = stored(measured(docs.select(col(docs, key).alias("k"), *[x.alias(n) for n, x in _slim(docs, text_col, lang_col, source_col).items()])))
    out = verdicts(rows, limits(rows))
    return out.select(F.col("k").alias(key), *BASE.names[:-1], F.col("failed").alias("base_failed"), F.col("stays").alias("kept"))


def filter_documents(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are, whatever their names.

    Null and empty texts fail; null languages and sources are groups of their own; equal rows stay or go together; an
    empty table stays empty. A first pass gathers the sketches from narrow rows; the second measures again beside the
    text, so that no text is shuffled.
    """
    narrow = _slim(docs, text_col, lang_col, source_col)
    found = limits(stored(measured(docs.select(*[x.alias(n) for n, x in narrow.items()]))))
    return unnested(verdicts(measured(nested(docs, **narrow)), found).filter("stays"), docs.columns)
