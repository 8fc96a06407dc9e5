"""Sharding by a permutation-filled lookup table (Maglev hashing).

Every shard has its own order of preference over the slots of a table of prime size; the shards take turns, each claiming
its next free slot. A row's slot is its key's hash modulo the table size, and its shard is looked up there. The table is
fixed in size whatever the number of rows, so it is broadcast and no row is shuffled. Shards differ by at most one slot,
and when a shard leaves or joins, few other keys move.

Defined results: a null key hashes as the empty text; rows with equal keys share a shard; an empty table gives an empty
table. The result has only the key and the columns named here, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> np.ndarray:
    """Index of the shard that owns each slot; ``slots`` must be a prime above the number of shards."""
    if not shards or slots <= len(shards) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"{slots} slots for {len(shards)} shards: a prime above the number of shards is needed")
    owner = np.full(slots, -1, np.int64)
    orders = [
        ((_hash(f"{name}|offset") % slots + np.arange(slots) * (_hash(f"{name}|skip") % (slots - 1) + 1)) % slots).tolist()
        for name in shards
    ]
    orders, free = [iter(order) for order in orders], slots
    while free:
        for shard, order in enumerate(orders):
            if not free:
                break
            slot = next(s for s in order if owner[s] < 0)
            owner[slot] = shard
            free -= 1
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % slots


def assign(df: DataFrame, key_col: str, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """``key_col, slot, shard`` for every row."""
    spark: SparkSession = df.sparkSession
    names = list(shards)
    rows = [(slot, names[shard]) for slot, shard in enumerate(lookup_table(names, slots).tolist())]
    places = spark.createDataFrame(rows, "slot long, shard string")
    keyed = df.select(F.col(key_col).alias("key"), slot_of(F.col(key_col), slots).alias("slot"))
    return keyed.join(F.broadcast(places), "slot").select(F.col("key").alias(key_col), "slot", "shard")


def write_sharded(df: DataFrame, key_col: str, shards: Sequence[str], path: str, files: int = 8) -> None:
    """Write whole rows in a folder per shard, each of ``files`` files, so that no task writes a whole shard."""
    names = list(shards)
    places = df.sparkSession.createDataFrame(list(enumerate(np.array(names)[lookup_table(names)].tolist())), "_slot long, _shard string")
    rows = df.select(F.struct("*").alias("row"), slot_of(F.col(key_col)).alias("_slot")).join(F.broadcast(places), "_slot")
    rows = rows.withColumn("_file", F.pmod(F.xxhash64("row"), F.lit(files))).repartition(files * len(names), "_shard", "_file")
    rows.select("row.*", F.col("_shard").alias("shard")).write.partitionBy("shard").parquet(path)
