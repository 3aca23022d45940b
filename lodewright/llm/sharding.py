"""Sharding by a permutation-filled lookup table, with DataFrame functions alone.

Every shard has its own order of preference over the slots of a table with a prime
number of slots (an offset and a step, both from a digest of its name). The shards take
turns claiming the free slot they like best, so slots are split as evenly as weights
allow and a change of shards moves few of them. A key's digest names its slot.

The table is broadcast: ``slots`` rows of two numbers, a fixed bound. Placing rows needs
no shuffle, and equal keys are placed alike however many they are.

Defined cases: a null key counts as the empty string; repeated rows are placed alike; an
empty table stays empty; earlier columns called slot and shard give way.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime far above the number of shards, so that shares differ by little.
SLOTS = 65_537


def _prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> list[int]:
    """The number of the shard that holds each slot. weights: turns that a shard has in each round, 1 if not named."""
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots or not _prime(slots):
        raise ValueError("shards must be distinct, at least one and at most as many as the prime number of slots")
    turns = [max(0, (weights or {}).get(s, 1)) for s in shards]
    if not any(turns):
        raise ValueError("some shard must have a weight above zero")
    digests = [hashlib.md5(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "big") % slots for d in digests]
    step = [int.from_bytes(d[8:], "big") % (slots - 1) + 1 for d in digests]
    table, left = [-1] * slots, slots
    while True:
        for shard, n in enumerate(turns):
            for _ in range(n):
                while table[at[shard]] >= 0:
                    at[shard] = (at[shard] + step[shard]) % slots
                table[at[shard]] = shard
                left -= 1
                if not left:
                    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 60 bits of its md5, modulo the slots."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long") % slots).cast("int")


def table_frame(spark: SparkSession, table: list[int]) -> DataFrame:
    """slot, shard: a binary literal of four bytes a slot, read at each slot's place."""
    packed = F.lit(bytearray(b"".join(x.to_bytes(4, "big") for x in table)))
    at = F.substring(packed, (F.col("id") * 4 + 1).cast("int"), F.lit(4))
    return spark.range(len(table)).select(F.col("id").cast("int").alias("slot"), F.conv(F.hex(at), 16, 10).cast("int").alias("shard"))


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS, weights: dict[str, int] | None = None) -> DataFrame:
    """``df`` with slot and shard (its number in ``shards``)."""
    table = table_frame(df.sparkSession, lookup_table(shards, slots, weights))
    return df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots)).join(F.broadcast(table), "slot").select(*(c for c in df.columns if c not in ("slot", "shard")), "slot", "shard")
