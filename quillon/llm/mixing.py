"""Mixing sources to target weights.

The words of each source, its documents laid end to end, are packed into blocks of a fixed length. Targets are shares of
the whole by weight, none above ``repeat`` times its source. The mix is made of output shards with a fixed number of
slots; each shard draws how many slots each source gets from a multinomial over what the sources still have to give,
so the sources' totals come out exactly while every shard is a random mix. A source's slots are mapped through
pseudorandom permutations of its block numbers (a Feistel network with cycle walking, one key per pass over the source),
and blocks are joined to slots by source and block number. The last slot of a source is cut where its target is reached.

Rows that agree in key, source and text are one unit that comes several times, counted before anything is moved. Offsets
are sums over small ranges of hashes first and over ranges next, so no source and no key is gathered in one task. What the
driver holds is one line per source and a draw per shard and source (MOST_SHARDS shards at most, larger ones beyond that).
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quillon.llm.common import col, map_arrow, nested, row_hash, small_side, stored

BLOCK, REPEAT, SHARD_SLOTS, MOST_SHARDS = 64, 3, 4096, 4096
#: Rows of a range of hashes, on average; ranges, as a power of two, that are summed up together; and copies of a unit.
RANGE_ROWS, RANGE_BITS, MOST_COPIES = 64, 12, 1024
_MASK = (1 << 64) - 1
WORD = r"[^\x20\x09-\x0D]+"
_WORD = re.compile(WORD.encode())


@dataclass(frozen=True)
class Source:
    """A source's number (by name, null last), words, target, and how its slots fill it."""

    number: int
    name: str | None
    rows: int
    size: int
    target: float
    block: int
    seed: int

    @property
    def blocks(self) -> int:
        return -(-self.size // self.block)

    @property
    def words(self) -> int:
        """What the mix takes: the target to a word."""
        return min(REPEAT * self.size, int(round(self.target)))

    @property
    def slots(self) -> int:
        """Slots until the words are reached."""
        passes, rest = divmod(self.words, self.size) if self.size else (0, 0)
        return passes * self.blocks + self._slots_of(passes, rest)

    def _short_at(self, turn: int) -> int:
        """Where in this pass the source's last, shorter block comes."""
        key = np.array([pass_key(self.seed, self.number, turn)], np.uint64)
        return int(permuted(np.array([self.blocks - 1]), np.array([self.blocks]), key, back=True)[0])

    def _slots_of(self, turn: int, rest: int) -> int:
        if not rest:
            return 0
        missing = self.blocks * self.block - self.size
        n = -(-rest // self.block)
        return n if self._short_at(turn) >= n or n * self.block - missing >= rest else n + 1

    def cut(self) -> tuple[int, int]:
        """The last slot, and how many words it gives; -1 if it gives all of its block."""
        passes, rest = divmod(self.words, self.size) if self.size else (0, 0)
        n = self._slots_of(passes, rest)
        if not n:
            return -1, 0
        short = self._short_at(passes)
        before = (n - 1) * self.block - ((self.blocks * self.block - self.size) if short < n - 1 else 0)
        return passes * self.blocks + n - 1, rest - before


def pass_key(seed: int, number: int, turn: int) -> int:
    x = (seed * 0x9E3779B97F4A7C15 + number * 0xC2B2AE3D27D4EB4F + turn * 0x165667B19E3779F9 + 1) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    return (x ^ (x >> 31)) & _MASK


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray, *, back: bool = False) -> np.ndarray:
    """The image of each index under a permutation of 0..n-1 (a Feistel network on the next even power of two, walked on
    until it falls inside); or, with ``back``, what maps to it."""
    n = np.broadcast_to(n, index.shape).astype(np.uint64)
    key = np.broadcast_to(key, index.shape).astype(np.uint64)
    half = np.ones(index.shape, np.uint64)
    while (big := (np.uint64(1) << (half * np.uint64(2))) < n).any():
        half[big] += np.uint64(1)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64).copy(), np.arange(len(index))
    rounds = range(4)[:: -1 if back else 1]
    while len(todo):
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for r in rounds:
            if back:
                left, right = right ^ _mix(left, k, r) & m, left
            else:
                left, right = right, left ^ _mix(right, k, r) & m
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def _mix(x: np.ndarray, key: np.ndarray, r: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + key + np.uint64(r * 0x9E3779B97F4A7C15 & _MASK)) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(29))


def targets(sizes: list[int], weights: list[float], repeat: int = REPEAT) -> list[float]:
    """Shares of the sum of sizes by weight; none above ``repeat`` times its size, the excess reshared by weight."""
    total, capped, out = float(sum(sizes)), set(), [0.0] * len(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in capped]
        left = total - sum(repeat * sizes[i] for i in capped)
        weight = sum(weights[i] for i in free)
        out = [float(repeat * sizes[i]) if i in capped else left * weights[i] / weight for i in range(len(sizes))]
        over = [i for i in free if out[i] > repeat * sizes[i]]
        if not over:
            return out
        capped.update(over)


def plan(totals: list[tuple[str | None, int, int]], weights: list[float] | None = None, *, block: int = BLOCK, seed: int = 0) -> list[Source]:
    """The sources, by name in code points (null last), with their targets. ``totals``: name, rows, words."""
    ordered = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    share = targets([n for _, _, n in ordered], weights or [1.0 + i % 3 for i in range(len(ordered))]) if ordered else []
    return [Source(i, name, rows, size, t, block, seed) for i, ((name, rows, size), t) in enumerate(zip(ordered, share, strict=True))]


def draws(sources: list[Source], seed: int = 0) -> pd.DataFrame:
    """How many slots each output shard draws from each source, and the first of them: columns shard, number, n, first.

    Multinomial over what each source still has to give; what goes beyond is drawn again from the others.
    """
    left = np.array([s.slots for s in sources], np.int64)
    given, total = np.zeros_like(left), int(left.sum())
    per = max(SHARD_SLOTS, -(-total // MOST_SHARDS))
    out = []
    for shard in range(-(-total // per)):
        rng = np.random.Generator(np.random.Philox(key=[seed, shard]))
        want, got = min(per, int(left.sum())), np.zeros_like(left)
        while want:
            room = left - got
            got += np.minimum(rng.multinomial(want, room / room.sum()), room)
            want = min(per, int(left.sum())) - int(got.sum())
        out += [(shard, i, int(n), int(g)) for i, (n, g) in enumerate(zip(got, given, strict=True)) if n]
        left, given = left - got, given + got
    return pd.DataFrame(out, columns=["shard", "number", "n", "first"]).astype("int64")


def _identity(key: Column, source: Column, text: Column) -> Column:
    """Two hashes that stand for a unit: key, source and text, nulls told from what is there."""
    parts = [y for x in (key, source, text) for y in (x.isNull(), x)]
    return F.struct(F.xxhash64(*parts).alias("x"), F.xxhash64(F.lit(1), *parts).alias("y"))


def units(docs: DataFrame, key: str, text_col: str, source_col: str) -> DataFrame:
    """Rows (id, part, k, source, size, m): what agrees in key, source and text, how many words it has and how often it comes.

    A unit that comes more than MOST_COPIES times has several parts.
    """
    k, source, text = col(docs, key), col(docs, source_col), col(docs, text_col)
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(_identity(k, source, text).alias("id"), k.alias("k"), source.alias("source"), size.alias("size"))
    counted = rows.groupBy("id", "k", "source", "size").agg(F.count(F.lit(1)).alias("all"))
    parts = counted.withColumn("part", F.explode(F.expr(f"sequence(0, (all - 1) div {MOST_COPIES})")))
    return parts.withColumn("m", F.least(F.col("all") - F.col("part") * MOST_COPIES, F.lit(MOST_COPIES))).drop("all")


def _lines(spark, sources: list[Source]) -> DataFrame:
    """A line per source, for joins: name, number, words, target and how many bits of a hash tell its ranges."""
    lines = [(s.name, s.number, s.size, s.target, max(1, math.ceil(math.log2(max(s.rows, 1) / RANGE_ROWS)) if s.rows > RANGE_ROWS else 1)) for s in sources]
    return small_side(spark.createDataFrame(lines, "name string, number long, source_size long, target double, bits int"))


def offsets(rows: DataFrame, sources: list[Source]) -> DataFrame:
    """The units with at least a word, with ``number`` and ``start``, their place in their source.

    The order is by a hash. Sums go up over two levels of its ranges, so that no source is ordered in one task.
    """
    numbered = rows.filter("size > 0").join(_lines(rows.sparkSession, sources), F.col("source").eqNullSafe(F.col("name"))).select("id", "part", "size", "m", "number", "bits")
    hashed = numbered.withColumn("h", F.xxhash64("id", "part", F.lit("order"))).withColumn("low", F.expr("shiftrightunsigned(h, 64 - bits)")).withColumn("high", F.shiftrightunsigned("low", RANGE_BITS))
    words = F.col("size") * F.col("m")
    low = hashed.groupBy("number", "high", "low").agg(F.sum(words).alias("s"))
    high = low.groupBy("number", "high").agg(F.sum("s").alias("s"))
    before = lambda df, part, order: (F.sum("s").over(W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, 0)) - F.col("s")).alias
    high = high.select("number", "high", before(high, ["number"], "high")("above"))
    low = low.select("number", "high", "low", before(low, ["number", "high"], "low")("before"))
    first = low.join(high, ["number", "high"]).select("number", "low", (F.col("before") + F.col("above")).alias("before"))
    inside = F.sum(words).over(W.partitionBy("number", "low").orderBy("h", "id", "part").rowsBetween(W.unboundedPreceding, 0)) - words
    return hashed.withColumn("inside", inside).join(first, ["number", "low"]).select("id", "part", "size", "m", "number", (F.col("before") + F.col("inside")).alias("start"))


def slots(spark, sources: list[Source], seed: int = 0) -> DataFrame:
    """The mix: a row (shard, number, slot, block, gives) for each slot; ``gives`` words of the block from its start."""
    if not sources or not sum(s.slots for s in sources):
        return spark.createDataFrame([], "shard long, number long, slot long, block long, gives long")
    drawn = spark.createDataFrame(draws(sources, seed))
    rows = drawn.repartition(spark.sparkContext.defaultParallelism).select("shard", "number", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"))
    by = {s.number: (s.blocks, s.size, s.block, *s.cut()) for s in sources}
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("shard", "number", "slot", "block", "gives")])

    def mapped(frames):
        for f in frames:
            number, slot = f["number"].to_numpy(), f["slot"].to_numpy()
            n, size, length, cut_at, cut_to = (np.array([by[i][j] for i in number], np.int64) for j in range(5))
            turn = slot // np.maximum(n, 1)
            keys = {(i, t): pass_key(seed, i, t) for i, t in set(zip(number.tolist(), turn.tolist(), strict=True))}
            at = permuted(slot % n, n, np.array([keys[i, t] for i, t in zip(number.tolist(), turn.tolist(), strict=True)], np.uint64))
            gives = np.where(slot == cut_at, cut_to, np.minimum(length, size - at * length))
            yield pd.DataFrame({"shard": f["shard"], "number": number, "slot": slot, "block": at, "gives": gives})

    return rows.mapInPandas(mapped, schema)


def segments(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """The packed blocks: a row for each block that a unit has words in, with the block's range of the unit's words."""
    cut = F.explode(F.expr(f"sequence(start div {block}, (start + size * m - 1) div {block})")).alias("block")
    rows = placed.select("id", "part", "number", "start", "size", "m", cut)
    low, high = F.greatest(F.col("block") * block, F.col("start")), F.least((F.col("block") + 1) * block, F.col("start") + F.col("size") * F.col("m"))
    return rows.select("id", "part", "number", "size", "block", (low - F.col("start")).alias("low"), (high - F.col("start")).alias("high"), (low - F.col("block") * block).alias("at"))


def layout(rows: DataFrame, sources: list[Source], *, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """What the mix is made of: rows (shard, slot, number, id, part, size, low, high), the words low to high of a unit.

    A unit that comes several times is its words that many times over. Slots are joined to blocks by source and number.
    """
    pieces, mix = segments(offsets(rows, sources), block), slots(rows.sparkSession, sources, seed).select("shard", "slot", F.col("number").alias("n"), F.col("block").alias("b"), "gives")
    high = F.least(F.col("high"), F.col("low") + F.col("gives") - F.col("at"))
    # the plan takes the slots for as few as the draws they come from; they are as many as the blocks
    met = pieces.join(mix.hint("shuffle_merge"), (F.col("number") == F.col("n")) & (F.col("block") == F.col("b")))
    return met.withColumn("high", high).filter("high > low").select("shard", "slot", "number", "id", "part", "size", "low", "high")


def _planned(docs: DataFrame, key: str, text_col: str, source_col: str, weights: list[float] | None, block: int, seed: int) -> tuple[DataFrame, list[Source]]:
    rows = stored(units(docs, key, text_col, source_col))
    totals = rows.groupBy("source").agg(F.sum("m").alias("n"), F.sum(F.col("size") * F.col("m")).alias("s")).collect()
    return rows, plan([(r["source"], r["n"], r["s"]) for r in totals], weights, block=block, seed=seed)


def taken(docs: DataFrame, key: str = "doc_id", *, text_col: str = "text", source_col: str = "source", weights: list[float] | None = None, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """Per row of ``docs``: key, size, source_size, target (its source's), taken, the words the mix takes of it, and n_shards, the output shards that hold some.

    A null or empty text has no words, and nothing is taken of it; null is a source of its own; a row's taken words are at
    most REPEAT times its size. Rows that agree in key, source and text share what is taken evenly. Reruns agree. An empty
    table gives an empty result. Other columns of ``docs`` may have any name.
    """
    rows, sources = _planned(docs, key, text_col, source_col, weights, block, seed)
    sums = layout(rows, sources, block=block, seed=seed).groupBy("id", "part", "shard").agg(F.sum(F.col("high") - F.col("low")).alias("t"))
    sums = sums.groupBy("id", "part").agg(F.sum("t").alias("t"), F.count(F.lit(1)).alias("n_shards")).select(F.col("id").alias("i"), F.col("part").alias("p"), "t", "n_shards")
    joined = rows.join(sums, (F.col("id") == F.col("i")) & (F.col("part") == F.col("p")), "left").join(_lines(rows.sparkSession, sources), F.col("source").eqNullSafe(F.col("name")))
    each = joined.withColumn("t", F.coalesce("t", F.lit(0))).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("m"))))
    even = F.expr("cast(t div m + if(copy <= t % m, 1, 0) as bigint)")
    return each.select(F.col("k").alias(key), "size", "source_size", "target", even.alias("taken"), F.coalesce("n_shards", F.lit(0)).cast("long").alias("n_shards"))


def _copies_of(text: str, ranges: list[tuple[int, int, int]]) -> list[tuple[str, int]]:
    """What the mix holds of a text, and how often: the words used once or more, those used twice or more, and so on.

    A use of all words is the text as it is; else the runs of words, as they stand in the text, joined by a space.
    """
    raw = text.encode("utf-8", "replace")
    spans = [m.span() for m in _WORD.finditer(raw)]
    change = np.zeros(len(spans) + 1, np.int64)
    for low, high, times in ranges:
        change[low] += times
        change[high] -= times
    used, done, out = np.cumsum(change[:-1]), 0, []
    for level in np.unique(used[used > 0]).tolist():  # up to each level the same words are used
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (used >= level).astype(np.int8), [0]])))
        runs = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
        whole = runs == [(0, len(spans))]
        out.append((text if whole else " ".join(raw[spans[a][0] : spans[b - 1][1]].decode("utf-8", "replace") for a, b in runs), level - done))
        done = level
    return out


def mix_documents(docs: DataFrame, key: str = "doc_id", *, text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars", weights: list[float] | None = None, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """The mix as documents: for each use of a row, its columns with the words that are used; ``length_col`` is kept true.

    A row comes up to REPEAT times, or not at all if the mix takes nothing of it; rows with null or empty texts don't
    come. Rows that agree in key, source and text are one unit; its uses have the other columns of the row with the
    smallest hash. An empty table gives an empty result. Texts are moved once, to meet the ranges that are used.
    """
    rows, sources = _planned(docs, key, text_col, source_col, weights, block, seed)
    used = layout(rows, sources, block=block, seed=seed).withColumn("copy", F.explode(F.expr("sequence(low div size, (high - 1) div size)")))
    low, high = F.greatest(F.col("low") - F.col("copy") * F.col("size"), F.lit(0)), F.least(F.col("high") - F.col("copy") * F.col("size"), F.col("size"))
    counted = used.select("id", low.alias("low"), high.alias("high")).groupBy("id", "low", "high").agg(F.count(F.lit(1)).alias("times"))
    # ranges lie within the text, so a list is no longer than that
    lists = counted.groupBy("id").agg(F.collect_list(F.struct("low", "high", "times")).alias("ranges")).select(F.col("id").alias("i"), "ranges")
    k, source, text = col(docs, key), col(docs, source_col), col(docs, text_col)
    full = nested(docs.filter(text.rlike(WORD)), id=_identity(k, source, text), order=row_hash(docs)).groupBy("id").agg(F.min_by("row", "order").alias("row"))
    joined = full.join(lists.hint("shuffle_merge"), F.col("id") == F.col("i")).select("row", F.col("row")[text_col].alias("body"), "ranges")
    schema = T.StructType([joined.schema["row"], T.StructField("cut", T.StringType()), T.StructField("times", T.LongType()), T.StructField("length", T.LongType())])

    def cut(rows: dict[str, list]) -> dict[str, list]:
        out: dict = {None: [], "cut": [], "times": [], "length": []}
        for i, (body, ranges) in enumerate(zip(rows["body"], rows["ranges"], strict=True)):
            for copy, times in _copies_of(body, [(r["low"], r["high"], r["times"]) for r in ranges]):
                for name, value in ((None, i), ("cut", copy), ("times", times), ("length", None if copy is body else len(copy))):
                    out[name].append(value)
        return out

    each = map_arrow(joined, cut, schema, carry=["row"]).withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    now = {text_col: F.col("cut")}
    if length_col in docs.columns:
        now[length_col] = F.coalesce(F.col("length").cast(docs.schema[length_col].dataType), F.col("row")[length_col])
    return each.select(*[now.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
