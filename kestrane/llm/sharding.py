"""Sharding by a permutation-filled lookup table.

Each shard has a permutation of the slots of a table of prime size: ``(offset + j * skip) mod size``. In turns, each shard claims
the next free slot of its permutation, until the table is full. A key goes to slot ``hash mod size``, so placement takes constant
time, shards get almost equal shares, and a change of the shard list moves few keys.

The table's rows (its size is a parameter, so its bytes are bounded whatever the data) are broadcast. Only DataFrame functions
touch the data. A null key is placed as the text ``\\N``; equal keys go to equal shards; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, free

#: Primes of about 250 slots for each of so many shards.
SIZES = (251, 1021, 4093, 16381, 65521, 262139, 1048573)
NULL_KEY = "\\N"


def table_size(n_shards: int) -> int:
    return next((s for s in SIZES if s >= 250 * n_shards), SIZES[-1])


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def lookup_table(shards: Sequence[str], size: int | None = None, weights: Sequence[int] | None = None) -> list[int]:
    """The shard number of each slot. A shard of weight k claims k slots in its turn."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, at least one")
    size = size or table_size(len(shards))
    if size < 2 or any(size % p == 0 for p in range(2, int(size**0.5) + 1)):
        raise ValueError(f"{size} is not a prime")
    if len(shards) > size:
        raise ValueError("more shards than slots")
    weights = weights or [1] * len(shards)
    offset = [_number(f"offset:{s}") % size for s in shards]
    skip = [_number(f"skip:{s}") % (size - 1) + 1 for s in shards]
    at, out, left = [0] * len(shards), [-1] * size, size
    while left:
        for i, w in enumerate(weights):
            for _ in range(w):
                slot = (offset[i] + at[i] * skip[i]) % size
                while out[slot] >= 0:
                    at[i] += 1
                    slot = (offset[i] + at[i] * skip[i]) % size
                out[slot] = i
                at[i] += 1
                left -= 1
                if not left:
                    return out
    return out


def slot_of(key: Column, size: int) -> Column:
    """The first 52 bits of the key's md5, mod size: the same in any engine that has md5."""
    text = F.coalesce(key.cast("string"), F.lit(NULL_KEY))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") % size).cast("int")


def placed(df: DataFrame, key: str, shards: Sequence[str], size: int | None = None, weights: Sequence[int] | None = None, prefix: str = "") -> DataFrame:
    """Adds ``slot`` and ``shard`` (the number in ``shards``), with ``prefix`` before both names. One broadcast join, no shuffle of the rows."""
    table, added = lookup_table(shards, size, weights), [f"{prefix}slot", f"{prefix}shard"]
    return beside(df, added, ["_table_slot", "_table_shard"], lambda inner, name: _placed(inner, name(key), table, *added))


def _placed(df: DataFrame, key: str, table: list[int], slot: str, shard: str) -> DataFrame:
    numbers = ",".join(map(str, table))
    lookup = df.sparkSession.range(1, numPartitions=1).select(F.posexplode(F.split(F.lit(numbers), ",")).alias("_table_slot", "_table_shard"))
    lookup = lookup.select("_table_slot", F.col("_table_shard").cast("int").alias(shard))
    return df.withColumn(slot, slot_of(F.col(key), len(table))).join(F.broadcast(lookup), F.col(slot) == F.col("_table_slot"), "left").drop("_table_slot")


def write_shards(df: DataFrame, path: str, key: str, shards: Sequence[str], files: int = 1) -> None:
    """Writes a folder for each shard with ``files`` parts each; a shard's rows are dealt over its parts by the key's hash."""
    slot, shard = free(df.columns, "_slot"), free(df.columns, "_shard")
    part = F.pmod(F.xxhash64(F.col(key)), F.lit(files))
    placed(df, key, shards, prefix="_").repartition(len(shards) * files, shard, part).drop(slot).write.partitionBy(shard).parquet(path)
