"""Sharding by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a table of prime size, from two hashes of its name. Shards
take turns; each claims the first slot of its permutation that is still free. A key's slot is its hash modulo
the size, so placement is one lookup in a broadcast table of SLOTS rows at most, whatever the data's size; a shard
that is added or lost moves few keys but its own.

Defined results: a null key is a key like others, in one slot; keys that are equal share a shard; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm._shared import free_name, table

#: A prime; and the bound of a table that is broadcast (some 30 MB).
SLOTS = 65537
MOST_SLOTS = 1 << 20
SHARDS = tuple(f"shard-{i:02d}" for i in range(16))


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _hash(name: str, salt: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8, salt=salt).digest(), "little")


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The index of the shard that holds each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards have names, all different")
    if not is_prime(slots) or slots < len(shards):
        raise ValueError("the count of slots is a prime, not under that of shards")
    begin = [_hash(s, b"begin") % slots for s in shards]
    step = [_hash(s, b"step") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    held, turn = [-1] * slots, [0] * len(shards)
    taken = 0
    while True:
        for i in range(len(shards)):
            while held[slot := (begin[i] + turn[i] * step[i]) % slots] >= 0:
                turn[i] += 1
            held[slot] = i
            taken += 1
            if taken == slots:
                return held


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def with_shard(df: DataFrame, key: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """df with the columns slot and shard (with underscores before these names where df has them); no shuffle."""
    if slots > MOST_SLOTS:
        raise ValueError(f"a table of more than {MOST_SLOTS} slots isn't broadcast")
    slot, shard = free_name(df.columns, "slot"), free_name(df.columns, "shard")
    place = free_name([*df.columns, slot, shard], "place")
    held = df.sparkSession.createDataFrame([(i, shards[s]) for i, s in enumerate(lookup_table(shards, slots))], f"`{place}` int, `{shard}` string")
    placed = df.withColumn(slot, slot_of(F.col(f"`{key}`"), slots))
    return placed.join(F.broadcast(held), F.col(slot) == F.col(place)).drop(place)


def write_shards(df: DataFrame, key: str, path: str, shards: Sequence[str] = SHARDS, files: int = 4) -> None:
    """A folder shard=... for each shard, of `files` files each (_shard=... where df has such a column).

    Rows of one key are in one shard, but in all of its files: a frequent key doesn't gather in one task.
    """
    placed = with_shard(df, key, shards)
    slot, shard = placed.columns[-2:]
    file = free_name(placed.columns, "file")
    placed = placed.withColumn(file, F.pmod(F.xxhash64(f"`{key}`", F.spark_partition_id()), F.lit(files)))
    placed.repartition(len(shards) * files, shard, file).drop(slot, file).write.partitionBy(shard).parquet(path)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, slot, shard and n_bytes of each document."""
    sized = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return with_shard(sized, "doc_id")
