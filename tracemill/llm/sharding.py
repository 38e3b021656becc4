"""Sharding by a permutation-filled lookup table.

A table of a prime number of slots is filled by the shards in turns: each has a preference order of the
slots, given by an offset and a skip from digests of its name, and claims the first free slot of it when
its turn comes. Every shard ends with as many slots as any other, give or take one (in proportion to the
weights, where shards have some), and adding or removing a shard moves few slots but its own.

A row's slot is a digest of its key modulo the number of slots; its shard is the table's entry there. The
table's size is fixed by its parameter, not by the data, so it is broadcast; placement is constant-time,
without a shuffle and without user functions. Keys are digests, so that hot sources and consecutive ids
spread evenly. A key that a third of all rows share can be salted: with ``salts`` above 1 a row's slot is that
of its key and of a digest of its columns (maps aside) modulo ``salts``, so a key has that many slots at most.

Defined results: a null key has a slot like any other value; repeated rows go to the same slot; an empty
table gives no rows; further columns are kept, and may have any name.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import table

#: A prime: 1024 slots for each shard, so that shards differ by a thousandth at most.
SLOTS = 65_537
SHARDS = 64


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], slots: int = SLOTS, weights: list[int] | None = None) -> list[int]:
    """The index of the shard that owns each slot. weights: claims of a shard in each turn."""
    if not is_prime(slots):
        raise ValueError(f"{slots} slots: not a prime number")
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards: none, repeated, or more than slots")
    word = lambda name, use: int.from_bytes(hashlib.sha256(f"{use}:{name}".encode()).digest()[:8], "big")
    at = [word(s, "offset") % slots for s in shards]
    skip = [word(s, "skip") % (slots - 1) + 1 for s in shards]
    owner, free = [-1] * slots, slots
    while free:
        for k in range(len(shards)):
            for _ in range(weights[k] if weights else 1):
                while owner[at[k]] >= 0:
                    at[k] = (at[k] + skip[k]) % slots
                owner[at[k]] = k
                free -= 1
                if not free:
                    return owner
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("\x00null"))), 1, 13), 16, 10).cast("long") % F.lit(slots)


def salted(df: DataFrame, key: Column, salts: int) -> Column:
    """The key with a digest of the row below ``salts``; the key alone if that is 1."""
    if salts < 1:
        raise ValueError("salts: less than 1")
    if salts == 1:
        return key
    whole = [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]
    return F.concat(F.coalesce(key.cast("string"), F.lit("\x00null")), F.lit("\x00"), F.pmod(F.xxhash64(*whole), F.lit(salts)).cast("string"))


def place(df: DataFrame, key: Column, shards: list[str], slots: int = SLOTS, weights: list[int] | None = None, slot: str = "slot", shard: str = "shard", salts: int = 1) -> DataFrame:
    """The input's columns, the row's slot and the index of its shard."""
    spark, owner = df.sparkSession, lookup_table(shards, slots, weights)
    entries = spark.createDataFrame(list(enumerate(owner)), "__slot long, __shard int")
    keyed = df.select(F.struct(*df.columns).alias("__row"), slot_of(salted(df, key, salts), slots).alias("__slot"))
    placed = keyed.join(F.broadcast(entries), "__slot")  # slots rows of two numbers
    return placed.select(*(F.col("__row")[c].alias(c) for c in df.columns), F.col("__slot").alias(slot), F.col("__shard").alias(shard))


def write_shards(df: DataFrame, key: Column, shards: list[str], path: str, files_per_shard: int = 1, salts: int = 1) -> None:
    """One folder for each shard; a row goes to the task of its slot at once, by number and not by another hash."""
    n = len(shards) * files_per_shard
    placed = place(df, key, shards, slot="__slot", shard="__shard", salts=salts)
    task = F.col("__shard") * files_per_shard + (F.col("__slot") % files_per_shard).cast("int")
    names = F.element_at(F.array(*map(F.lit, shards)), F.col("__shard") + 1)
    placed.repartitionById(n, task.cast("int")).withColumn("shard", names).drop("__slot", "__shard").write.partitionBy("shard").parquet(path)


def shard_names(n: int) -> list[str]:
    return [f"shard-{k:05d}" for k in range(n)]


def op9_permutation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return place(docs, F.col("doc_id"), shard_names(SHARDS))


def oracle_sql() -> str:
    """DuckDB's SQL; the table's entries stand in it as a list."""
    return f"""
WITH s AS (
  SELECT doc_id, source, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), chr(0) || 'null')), 1, 13) AS BIGINT) % {SLOTS} AS slot FROM documents
)
SELECT doc_id, source, slot, CAST({lookup_table(shard_names(SHARDS))}[slot + 1] AS INTEGER) AS shard FROM s
"""
