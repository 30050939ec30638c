"""Shard placement by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table, given by an
offset and a step. In turns, each shard claims the next free slot of its permutation
until all are taken, so shares differ by one slot at most and adding or removing a
shard moves few keys. The table is small and of fixed size; it is broadcast, and a key
finds its shard by one hash and one lookup.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fresh

#: A prime, over a hundred times the shards. It bounds the broadcast.
SLOTS = 8191
SHARDS = 64
MAX_SLOTS = 1_000_003


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % i for i in range(2, int(n**0.5) + 1))


def _digest(seed: str, shard: int) -> int:
    return int(hashlib.md5(f"{seed}:{shard}".encode()).hexdigest()[:15], 16)


def fill(shards: list[int], slots: int = SLOTS) -> list[int]:
    """The table: the shard of every slot. Empty shard lists and non-prime sizes are errors."""
    if not shards or not _is_prime(slots) or not len(shards) <= slots <= MAX_SLOTS:
        raise ValueError(f"needs 1 to {slots} shards and a prime number of slots up to {MAX_SLOTS}")
    offset = {s: _digest("offset", s) % slots for s in shards}
    step = {s: _digest("step", s) % (slots - 1) + 1 for s in shards}
    turn = dict.fromkeys(shards, 0)
    table = [-1] * slots
    left = slots
    while True:
        for s in shards:
            while True:
                slot = (offset[s] + turn[s] * step[s]) % slots
                turn[s] += 1
                if table[slot] < 0:
                    break
            table[slot] = s
            left -= 1
            if not left:
                return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key, from the first 60 bits of its MD5 digest; a null key has the empty string's."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def lookup(spark: SparkSession, shards: list[int], slots: int = SLOTS) -> DataFrame:
    table = ",".join(map(str, fill(shards, slots)))
    return spark.range(1).select(F.posexplode(F.split(F.lit(table), ",")).alias("slot", "shard")).select(
        "slot", F.col("shard").cast("int").alias("shard")
    )


def place(df: DataFrame, key_col: str, shards: list[int] | None = None, slots: int = SLOTS) -> DataFrame:
    """``df`` with columns ``slot`` and ``shard`` (replaced if they exist).

    Equal keys share a shard, null keys that of the empty string; every row of ``df``,
    repeated ones included, is placed. An empty table stays empty. Placement is a
    broadcast lookup without a shuffle, so a hot key is no burden here.
    """
    at = fresh(df, "_slot")
    table = lookup(df.sparkSession, shards or list(range(SHARDS)), slots).withColumnRenamed("slot", at)
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("slot", "shard")]
    placed = df.select(*rest, slot_of(F.col(f"`{key_col}`"), slots).alias(at)).join(F.broadcast(table), at)
    return placed.withColumnRenamed(at, "slot")
