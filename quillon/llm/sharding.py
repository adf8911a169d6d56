"""Sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a table of prime size: start + step * j modulo the size, with start
and step from hashes of its name. Shards take turns claiming the next free slot of their order until the table is full,
so all get equally many slots to within one, and adding or removing a shard moves few slots but its own. A key's slot is
a hash modulo the size; the table (two integers a slot, MOST_SLOTS slots at most) is broadcast, so that placement is one
hash lookup per row, without a shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import col, nested, row_hash

SHARDS, SLOTS = 64, 10_007
#: The bound on what is broadcast: some 16 MB.
MOST_SLOTS = 1_000_003


def _number(text: str, part: int) -> int:
    return int(hashlib.sha256(f"{part}:{text}".encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % i for i in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The shard (its index in ``shards``) of each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct, one at least")
    if not is_prime(slots) or not len(shards) <= slots <= MOST_SLOTS:
        raise ValueError(f"slots must be a prime from {len(shards)} to {MOST_SLOTS}")
    start, step, at = [_number(s, 0) % slots for s in shards], [_number(s, 1) % (slots - 1) + 1 if slots > 2 else 1 for s in shards], [0] * len(shards)
    table, free = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            slot = (start[i] + step[i] * at[i]) % slots
            while table[slot] >= 0:
                at[i] += 1
                slot = (start[i] + step[i] * at[i]) % slots
            table[slot] = i
            at[i] += 1
            free -= 1
            if not free:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: 60 bits of its MD5 modulo the table's size. A null key hashes as an empty one."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(df: DataFrame, key: str, shards: Sequence[str], *, slots: int = SLOTS, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """All columns of ``df`` with the slot and shard number of ``key``; other columns of these names are replaced.

    Equal keys have equal shards, whatever else the rows hold; a null key counts as empty; an empty table gives an empty
    result. The key itself is always kept, so it may not be named like a result.
    """
    if key.lower() in (slot_col.lower(), shard_col.lower()):
        raise ValueError(f"the key {key} has the name of a result; give slot_col and shard_col others")
    listed = ",".join(map(str, fill_table(shards, slots)))
    table = df.sparkSession.range(1).select(F.posexplode(F.split(F.lit(listed), ",")).alias("slot", "shard"))
    placed = nested(df, at=slot_of(col(df, key), slots)).join(F.broadcast(table), F.col("at") == F.col("slot"))
    others = [c for c in df.columns if c.lower() not in (slot_col.lower(), shard_col.lower())]
    return placed.select(*[F.col("row")[c].alias(c) for c in others], F.col("at").alias(slot_col), F.col("shard").cast("int").alias(shard_col))


def write_sharded(df: DataFrame, key: str, shards: Sequence[str], path: str, *, slots: int = SLOTS, parts: int = 8, shard_col: str = "shard") -> None:
    """Write ``df`` as Parquet, a folder per shard and up to ``parts`` files in each; a hot shard is dealt over its parts too.

    A row's part is a hash of its columns, so a task that runs again deals its rows as before. A column named like
    ``shard_col`` is replaced by the shard; a null key counts as empty; an empty table writes no shard.
    """
    own = [c for c in df.columns if c.lower() != shard_col.lower()]
    slot = next(f"slot{'_' * n}" for n in range(len(own) + 1) if f"slot{'_' * n}" not in {c.lower() for c in own})
    part = next(f"part{'_' * n}" for n in range(len(own) + 1) if f"part{'_' * n}" not in {c.lower() for c in own})
    dealt = df.withColumn(part, F.pmod(F.xxhash64(row_hash(df)), F.lit(parts)))
    placed = place(dealt, key, shards, slots=slots, slot_col=slot, shard_col=shard_col).drop(slot)
    placed.repartition(len(shards) * parts, shard_col, part).drop(part).write.partitionBy(shard_col).parquet(path)
