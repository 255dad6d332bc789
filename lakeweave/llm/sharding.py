"""Sharding by a permutation-filled lookup table (operator 9), in DataFrame operations only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the table; a prime, far above the number of shards. The broadcast table has exactly so many rows.
SLOTS = 65_537


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


def lookup(shards: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the number of its shard.

    Shard i's preference order is offset, offset + skip, offset + 2 skip, ... modulo the prime number of slots, which
    visits each slot once. In turns each shard claims the first slot of its order that is still free. A shard that goes
    or comes moves few slots besides its own.
    """
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct names, at least one and at most as many as slots")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime")
    at = [_number(f"{s}/offset") % slots for s in shards]
    skip = [_number(f"{s}/skip") % (slots - 1) + 1 for s in shards]
    table, free = [-1] * slots, slots
    while free:
        for i in range(min(len(shards), free)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
        free -= min(len(shards), free)
    return table


def slot_of(keys: list[Column], slots: int = SLOTS) -> Column:
    """The slot of a row: 48 bits of the MD5 of its keys as text (null: \\N), separated by U+001F, modulo the slots."""
    joined = F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("\\N")) for k in keys])
    return (F.conv(F.substring(F.md5(joined), 1, 12), 16, 10).cast("long") % slots).cast("int")


def table_frame(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """(slot, shard): `slots` rows."""
    numbers = ",".join(map(str, lookup(shards, slots)))
    names = F.split(F.lit("\x1f".join(shards)), "\x1f")
    own = F.element_at(F.split(F.lit(numbers), ","), F.col("id").cast("int") + 1).cast("int")
    return spark.range(slots).select(F.col("id").cast("int").alias("slot"), F.element_at(names, own + 1).alias("shard"))


def place(df: DataFrame, keys: list[str], shards: list[str], slots: int = SLOTS, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """df with its rows' slot and shard; no row moves, as the table is broadcast (it has `slots` rows, whatever df has).

    Rows with equal keys, null or not, share a shard; use a key fine enough that no value holds a large share of the
    rows. Columns of df named like the two new ones are replaced. An empty table stays empty.
    """
    held = table_frame(df.sparkSession, shards, slots).select(F.col("slot").alias("__slot"), F.col("shard").alias("__shard"))
    out = df.withColumn("__at", slot_of([df[k] for k in keys], slots)).join(F.broadcast(held), F.col("__at") == F.col("__slot"), "left")
    return out.withColumns({slot: F.col("__at"), shard: F.col("__shard")}).drop("__at", "__slot", "__shard")


def write(df: DataFrame, path: str, keys: list[str], shards: list[str], parts: int = 1) -> None:
    """Writes df as one folder a shard, each of `parts` files that split the shard's slots evenly."""
    placed = place(df, keys, shards, slot="__slot_no", shard="shard").withColumn("__part", F.col("__slot_no") % parts)
    placed.repartition(len(shards) * parts, "shard", "__part").drop("__slot_no", "__part").write.partitionBy("shard").parquet(path)
