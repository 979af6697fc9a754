"""Sharding by a permutation-filled lookup table.

Each shard prefers the slots of a prime-sized table in an order of its own, a start and a
step derived from its name. The shards take turns, each claiming its next free slot, until
the table is full; so shards hold equally many slots give or take one, and few slots change
hands when a shard comes or goes. A row's key picks a slot, the slot its shard.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm import common

SHARDS, SLOTS = 32, 2039
#: Hexadecimal digits of an MD5 that make a number.
DIGITS = 15
#: A table up to this size is a few hundred KB, which any executor can hold.
MOST_SLOTS = 1 << 17


def number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:DIGITS], 16)


def names(shards: int) -> list[str]:
    return [f"shard-{i}" for i in range(shards)]


def filled(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard of each slot."""
    if not shards or len(set(shards)) != len(shards) or not len(shards) <= slots <= MOST_SLOTS:
        raise ValueError(f"shards must be distinct and from 1 to `slots`, which is at most {MOST_SLOTS}")
    if slots < 2 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime, so that every step visits all of them")
    start = [number(f"{s}/start") % slots for s in shards]
    step = [number(f"{s}/step") % (slots - 1) + 1 for s in shards]
    at, table, free = [0] * len(shards), [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            while table[slot := (start[i] + at[i] * step[i]) % slots] >= 0:
                at[i] += 1
            table[slot] = i
            free -= 1
            if not free:
                break
    return table


def lookup(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """The table as rows (slot, shard); its size is bounded by MOST_SLOTS."""
    held = F.array(*map(F.lit, filled(shards, slots)))
    return spark.range(1).select(F.posexplode(held).alias("slot", "shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key, from the MD5 of its text; null counts as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit("")).cast("binary")
    return (F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long") % slots).cast("int")


def sharded(docs: DataFrame, key: str = "doc_id", shards: int | list[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """docs with a column shard (a number from 0): rows of equal key share a shard.

    Rows without a key share one as well. All columns stay; one named shard is replaced. The
    table is broadcast, so rows are placed where they are read and nothing is shuffled.
    """
    table = lookup(docs.sparkSession, names(shards) if isinstance(shards, int) else shards, slots)
    table = table.select(F.col("slot").alias("_at"), F.col("shard").alias("_shard"))
    marked = common.packed(docs, slot_of(F.col(f"`{key}`"), slots).alias("_slot"))
    out = marked.join(F.broadcast(table), F.col("_slot") == F.col("_at"))
    kept = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c.lower() != "shard"]
    return out.select(*kept, F.col("_shard").alias("shard"))
