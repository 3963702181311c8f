"""Sharding by a permutation-filled lookup table.

Every shard has its own preference order over the slots of a prime-sized
table, and the shards take turns claiming their next free slot. The table has
a fixed size (the smallest prime of at least 100 slots a shard), so it is built
once and broadcast; placing a row is one hash and one lookup, with no shuffle.
Adding or removing a shard moves only a few slots beside those it takes over.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS = 64
SLOTS_PER_SHARD = 100
#: Most slots a table may have: bounds what placement broadcasts (a row of 12 bytes a slot).
MOST_SLOTS = 1_000_003


def next_prime(n: int) -> int:
    n = max(2, n)
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill_table(shards: list[str], slots: int) -> list[int]:
    """Index of the shard that owns each slot. ``slots`` must be prime and no less than the number of shards."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be distinct, and there must be one at least")
    if slots < len(shards) or slots > MOST_SLOTS or next_prime(slots) != slots:
        raise ValueError(f"slots must be a prime from the number of shards to {MOST_SLOTS}")
    place = [_number(f"offset:{s}") % slots for s in shards]
    step = [_number(f"skip:{s}") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    owner, free = [-1] * slots, slots
    while free:
        for k in range(len(shards)):
            while owner[place[k]] >= 0:
                place[k] = (place[k] + step[k]) % slots
            owner[place[k]], free = k, free - 1
            if not free:
                break
    return owner


def slot_of(key: Column, slots: int) -> Column:
    """Slot of a key: the first 60 bits of its MD5 digest, modulo the table size. A null key counts as an empty one."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def _packed(owner: list[int]) -> str:
    return "".join(f"{k:05x}" for k in owner)


def lookup_table(spark, owner: list[int]) -> DataFrame:
    """The table as rows (slot, shard), unpacked from one literal inside Spark."""
    at = F.substring(F.lit(_packed(owner)), (F.col("id") * 5 + 1).cast("int"), F.lit(5))
    return spark.range(len(owner)).select(F.col("id").cast("int").alias("slot"), F.conv(at, 16, 10).cast("int").alias("shard"))


def assign_shards(df: DataFrame, key: str, shards: list[str] | None = None, slots: int | None = None, spread_by: str | None = None, spread: int = 1) -> DataFrame:
    """Add ``slot`` and ``shard`` to every row.

    Equal keys go to one shard. Where one key may hold a large part of all rows, ``spread`` > 1 deals the
    rows of each key to that many places by the hash of ``spread_by``. Null keys are placed like the empty
    key; repeated rows share a shard; an empty table gives an empty one; columns named ``slot`` or ``shard``
    in the input are replaced.
    """
    shards = shards or [f"shard-{k:03d}" for k in range(SHARDS)]
    slots = slots or next_prime(SLOTS_PER_SHARD * len(shards))
    place = F.coalesce(F.col(key).cast("string"), F.lit(""))
    if spread > 1:
        place = F.concat_ws("#", place, F.pmod(F.xxhash64(F.col(spread_by or key)), F.lit(spread)).cast("string"))
    owners = F.broadcast(lookup_table(df.sparkSession, fill_table(shards, slots)))
    return df.drop("slot", "shard").withColumn("slot", slot_of(place, slots)).join(owners, "slot", "left")


def assign_shards_sql(table: str, key: str, shards: list[str] | None = None) -> str:
    """The placement of ``assign_shards`` in SQL; the filled table comes in as one literal."""
    shards = shards or [f"shard-{k:03d}" for k in range(SHARDS)]
    slots = next_prime(SLOTS_PER_SHARD * len(shards))
    packed = _packed(fill_table(shards, slots))
    return f"""
WITH placed AS (
  SELECT {key}, CAST(CAST('0x' || substr(md5(coalesce(CAST({key} AS VARCHAR), '')), 1, 15) AS BIGINT) % {slots} AS INTEGER) AS slot
  FROM {table}
), owners AS (
  SELECT CAST(i AS INTEGER) AS slot, CAST('0x' || substr('{packed}', CAST(i * 5 + 1 AS INTEGER), 5) AS INTEGER) AS shard
  FROM range({slots}) t(i)
)
SELECT {key}, slot, shard FROM placed JOIN owners USING (slot)
"""
