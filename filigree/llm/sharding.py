"""Operator 1: sharding by a permutation-filled lookup table.

Every shard has a permutation of the slots of a table of prime size, given by
an offset and a step. The shards take turns; each claims the first free slot of
its own permutation, until all slots are taken. So shard sizes differ by one
slot at most, and removing a shard moves few other keys. The table does not
depend on the data: its size is the parameter ``slots`` (a few kB), so it is
planned on the driver and broadcast; a document is placed by one hash and one
look-up. Placement uses DataFrame functions only.

Defined results: rows with equal keys go to the same shard; a null key counts
as the empty string and is placed like any other; an empty table gives no
rows; columns of the input named like an output column are replaced; texts are not
read, so their length plays no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm.frames import table

#: Production parameters: 64 shards, a prime of about 128 slots a shard.
SHARDS, SLOTS = 64, 8191


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], slots: int) -> list[int]:
    """The index into ``shards`` that owns each slot."""
    if not shards:
        raise ValueError("at least one shard is needed")
    if len(set(shards)) != len(shards):
        raise ValueError("shard names must differ")
    if not _is_prime(slots) or slots < len(shards):
        raise ValueError("slots must be a prime not below the number of shards")
    at, step = [], []
    for name in shards:
        digest = hashlib.md5(name.encode()).digest()
        at.append(int.from_bytes(digest[:8], "big") % slots)
        step.append(int.from_bytes(digest[8:], "big") % (slots - 1) + 1)
    owner, free = [-1] * slots, slots
    while free:
        for s in range(len(shards)):
            while owner[at[s]] >= 0:
                at[s] = (at[s] + step[s]) % slots
            owner[at[s]] = s
            free -= 1
            if not free:
                break
    return owner


def shard_names(n: int) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def slot_of(key: Column, slots: int) -> Column:
    """60 bits of the key's MD5, modulo the table's size."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(slots)


def shard(df: DataFrame, key: str = "doc_id", shards: Sequence[str] | None = None, slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` (long) and ``shard`` (int, index into ``shards``)."""
    owner = lookup_table(shards or shard_names(SHARDS), slots)
    owners = df.sparkSession.sql(f"SELECT CAST(pos AS BIGINT) AS slot, CAST(o AS INT) AS shard FROM (SELECT posexplode(split('{','.join(map(str, owner))}', ',')) AS (pos, o))")
    kept = [c for c in df.columns if c.lower() not in ("slot", "shard")]
    return df.select(*[F.col(f"`{c}`") for c in kept]).withColumn("slot", slot_of(F.col(f"`{key}`"), slots)).join(F.broadcast(owners), "slot", "left").select(*[F.col(f"`{c}`") for c in kept], "slot", "shard")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id"))


OP1_SQL = f"""
WITH owners AS (SELECT [{",".join(map(str, lookup_table(shard_names(SHARDS), SLOTS)))}] AS o),
placed AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents)
SELECT doc_id, slot, o[slot + 1]::INTEGER AS shard FROM placed, owners
"""
