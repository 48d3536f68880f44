"""Consistent placement by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table. Shards take turns; in its turn a shard claims the
first slot of its permutation that is still free. All shards end with the same number of slots (one more or less), and when a
shard goes, hardly any slot but its own changes hands. Placing a row is one hash and one lookup in a broadcast table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 5003  # prime; some 80 slots for each of 64 shards, so sizes differ by about 1 %


def preference(shard: str, slots: int) -> tuple[int, int]:
    """First slot and step of the shard's permutation; any step below a prime visits all slots."""
    digest = hashlib.md5(shard.encode()).hexdigest()
    return int(digest[:8], 16) % slots, int(digest[8:16], 16) % (slots - 1) + 1


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """Owner (position in ``shards``) of each slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shard names must be given and differ")
    if slots < max(2, len(shards)) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"{slots} slots: a prime number, at least the number of shards, is needed")
    owner, step = [-1] * slots, [preference(s, slots) for s in shards]
    at = [first for first, _ in step]
    for turn in range(slots):
        s = turn % len(shards)
        while owner[at[s]] >= 0:
            at[s] = (at[s] + step[s][1]) % slots
        owner[at[s]] = s
    return owner


def lookup(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """The table as rows (slot, shard); its size is the number of slots, whatever the data."""
    owner = F.split(F.lit(",".join(map(str, fill(shards, slots)))), ",")
    names = F.split(F.lit("\n".join(shards)), "\n")
    return spark.range(1).select(F.posexplode(owner).alias("slot", "owner")).select(F.col("slot").cast("long"), F.get(names, F.col("owner").cast("int")).alias("shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key by the first 60 bits of its MD5; a null key counts as an empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long") % slots


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """Adds ``slot`` and ``shard`` to every row; columns of these names in ``df`` are replaced.

    Equal keys share a shard, repeated rows stay repeated, null keys go where the empty text goes, an empty table stays empty.
    """
    rows = df.withColumn("slot", slot_of(F.col(key), slots)).drop("shard")
    return rows.join(F.broadcast(lookup(df.sparkSession, shards, slots)), "slot")


def write_shards(df: DataFrame, path: str, key: str, shards: list[str], rows_per_file: int = 1_000_000, slots: int = SLOTS) -> None:
    """One folder for each shard. Rows are dealt by slot, a shard's part of the key space, so that a large shard has many writers."""
    place(df, key, shards, slots).repartition(F.col("slot")).write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
