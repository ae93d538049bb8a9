"""Sharding by a permutation-filled lookup table (consistent hashing with near-equal shares).

A table of a prime number of slots is filled once: each shard has its own preference order of all slots, a
permutation by offset and skip, and the shards take turns, each claiming its next free slot, until the table
is full. Shares differ by at most one slot, and adding or removing a shard moves little more than its own
share. A row's slot is a hash of its key modulo the table size; its shard is looked up in a broadcast table.

Scale. The table is bounded by its size, a parameter, and so is the broadcast. Placement is a map without a
shuffle; keys decide alone, so a hot source is spread by its documents' ids. `write_sharded` moves rows to
their shard's files in `files_per_shard` parts, so a shard is never one task.

Edge cases. A null key hashes to the slot of the empty key. Repeated rows share a slot. Column names of the
result that the input has already are replaced. Empty tables give no rows. A table size that is not prime or
smaller than the number of shards, or no shards, is an error, and so are repeated shard names."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 64
SLOTS = 16_411  # a prime over 250 times the shards: shares are equal within half a percent
MAX_SLOTS = 10_000_000
_KEY_DIGITS = 13  # 52 bits of the key's MD5, exact in every engine's numbers


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """The shard (its place in the list) of each slot."""
    if not shards or len(set(shards)) != len(shards) or not _is_prime(slots) or not len(shards) <= slots <= MAX_SLOTS:
        raise ValueError("needs different shards and a prime table size of at least as many slots")
    nxt = [_number(f"{name}:offset") % slots for name in shards]
    skip = [_number(f"{name}:skip") % (slots - 1) + 1 if slots > 2 else 1 for name in shards]
    table, free = [-1] * slots, slots
    while free:
        for shard in range(len(shards)):
            while table[nxt[shard]] >= 0:
                nxt[shard] = (nxt[shard] + skip[shard]) % slots
            table[nxt[shard]] = shard
            free -= 1
            if not free:
                break
    return table


def shard_names(count: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(count)]


def table_frame(spark: SparkSession, table: Sequence[int]) -> DataFrame:
    """slot and shard, one row per slot."""
    listed = F.split(F.lit(",".join(map(str, table))), ",")
    rows = spark.range(1, numPartitions=1).select(F.posexplode(listed).alias("slot", "shard"))
    return rows.select(F.col("slot").cast("long"), F.col("shard").cast("int"))


def slot_of(key, slots: int = SLOTS):
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, _KEY_DIGITS), 16, 10).cast("long"), F.lit(slots))


def place(rows: DataFrame, key: str, table: Sequence[int]) -> DataFrame:
    """rows with their slot and shard; the key itself cannot have one of these names."""
    if key in ("slot", "shard"):
        raise ValueError(f"the key column is named {key!r}, as a column of the result is: rename it first")
    keyed = rows.drop("slot", "shard").withColumn("slot", slot_of(F.col(f"`{key}`"), len(table)))
    lookup = table_frame(rows.sparkSession, table)
    return keyed.join(F.broadcast(lookup), "slot").select(*keyed.columns, "shard")  # bounded by MAX_SLOTS


def moved(rows: DataFrame, key: str, before: Sequence[int], after: Sequence[int]) -> DataFrame:
    """Rows whose shard number changes between two tables of one size, with from_shard and to_shard."""
    if len(before) != len(after):
        raise ValueError("tables of one size only")
    old = place(rows, key, before).withColumnRenamed("shard", "from_shard").drop("slot")
    new = place(old, key, after).withColumnRenamed("shard", "to_shard").drop("slot")
    return new.where("from_shard <> to_shard")


def write_sharded(rows: DataFrame, key: str, table: Sequence[int], path: str, files_per_shard: int = 4) -> None:
    """Parquet with a folder per shard, each of files_per_shard files dealt by slot."""
    placed = place(rows, key, table)
    part = F.pmod(F.xxhash64("slot", F.xxhash64(F.col(f"`{key}`"))), F.lit(files_per_shard))
    count = files_per_shard * (max(table) + 1)
    placed.repartition(count, "shard", part).write.partitionBy("shard").parquet(path)


def oracle(slots: int = SLOTS, shards: int = SHARDS) -> str:
    """DuckDB SQL of the query; the table is filled by the rule's plain reading, slot by slot."""
    table, turn = {}, 0

    def order(name: str):
        first, skip = _number(f"{name}:offset") % slots, _number(f"{name}:skip") % (slots - 1) + 1
        return iter([(first + i * skip) % slots for i in range(slots)])

    orders = [order(name) for name in shard_names(shards)]
    while len(table) < slots:
        table.setdefault(next(s for s in orders[turn % shards] if s not in table), turn % shards)
        turn += 1
    listed = ",".join(str(table[s]) for s in range(slots))
    number = f"cast(concat('0x', substr(md5(coalesce(cast(doc_id as varchar), '')), 1, {_KEY_DIGITS})) as bigint)"
    return (
        f"with t as (select [{listed}] as shards), d as (select doc_id, {number} % {slots} as slot from documents) "
        "select doc_id, slot, cast(shards[slot + 1] as integer) as shard from d, t"
    )
