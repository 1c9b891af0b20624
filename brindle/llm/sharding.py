"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a prime-sized
table: it starts at an offset and walks with a stride, both from a hash of its
name, which visits every slot once because the size is prime. The shards take
turns, each claiming its first free slot, until the table is full; so each owns
an equal number of slots to within one (or its share by weight), and a shard
that joins or leaves moves few slots. A key's slot is a hash modulo the size,
and its shard is one lookup in the broadcast table.

Defined cases: a null key counts as the empty text; equal keys (repeated rows)
always meet in the same shard; an empty table gives an empty result; extra
columns are kept, and those that bear the name of an output column (in capitals or
not; the key may be one of them) are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import unused_name

#: The largest table that may be broadcast, in slots (12 bytes each).
MAX_SLOTS = 4_000_037


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big")


def fill_table(shards: Sequence[str], size: int, weights: Sequence[int] | None = None) -> list[int]:
    """The shard index of each slot. ``weights``: how many turns a shard has in each round (1 each)."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    if not _is_prime(size) or size > MAX_SLOTS or size < len(shards):
        raise ValueError(f"size must be a prime from the number of shards to {MAX_SLOTS}")
    weights = weights or [1] * len(shards)
    if len(weights) != len(shards) or min(weights) < 1:
        raise ValueError("each shard needs a weight of 1 or more")
    place = [_digest(f"offset/{s}") % size for s in shards]
    stride = [_digest(f"stride/{s}") % (size - 1) + 1 for s in shards]
    table, free = [-1] * size, size
    while free:
        for k, turns in enumerate(weights):
            for _ in range(turns):
                while table[place[k]] >= 0:
                    place[k] = (place[k] + stride[k]) % size
                table[place[k]] = k
                free -= 1
                if not free:
                    return table
    return table


def slot_of(key: Column, size: int) -> Column:
    """The slot of a key: the leading 60 bits of its MD5 modulo the table's size."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"), F.lit(size))


def lookup_frame(spark: SparkSession, table: Sequence[int]) -> DataFrame:
    return spark.createDataFrame([(i, k) for i, k in enumerate(table)], "slot long, shard int")


def assign_shards(
    df: DataFrame, key: str, shards: Sequence[str], size: int, weights: Sequence[int] | None = None
) -> DataFrame:
    """``df`` with its ``slot`` and ``shard``; no row moves, since the table of at most ``MAX_SLOTS`` is broadcast."""
    kept = [c for c in df.columns if c.lower() not in ("slot", "shard")]
    at = unused_name(df)
    slotted = df.select(*[F.col(f"`{c}`") for c in kept], slot_of(F.col(f"`{key}`"), size).alias(at))
    table = lookup_frame(df.sparkSession, fill_table(shards, size, weights)).toDF(at, f"{at}_shard")
    return slotted.join(F.broadcast(table), at).select(*[F.col(f"`{c}`") for c in kept], F.col(at).alias("slot"), F.col(f"{at}_shard").alias("shard"))


def write_shards(assigned: DataFrame, path: str, salts: int = 8) -> None:
    """Write one folder per shard, each by ``salts`` tasks so that none takes a whole shard."""
    salt, name = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in assigned.columns if c != "shard"]), F.lit(salts)), unused_name(assigned)
    assigned.withColumn(name, salt).repartition("shard", name).drop(name).write.partitionBy("shard").parquet(path)
