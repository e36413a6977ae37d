"""Placement of keys on shards by a permutation-filled lookup table.

Each shard prefers the slots of a prime-sized table in an order of its own, a
permutation that a hash of its name gives. Shards take turns claiming the best slot
that is still free until all are taken, so every shard has as many slots as any other,
or one more, and if a shard goes, few keys move between the others. A key's slot is a
hash of it; the table, of as many rows as it has slots and no more, is broadcast, which
makes a placement one probe of a hash table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.shared import free_name

#: Slots of the default table: a prime, a hundred for each shard.
SLOTS = 3203
#: Of a larger table the broadcast would not be small any more.
MOST_SLOTS = 1 << 21
SHARDS = tuple(f"shard-{i:02d}" for i in range(32))


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def preference(shard: str, slots: int) -> tuple[int, int]:
    """First slot and step of a shard's permutation."""
    return _hash(f"offset:{shard}") % slots, _hash(f"skip:{shard}") % (slots - 1) + 1


def fill(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """For each slot, the index of the shard that claims it."""
    if slots < 2 or slots > MOST_SLOTS or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime of at most {MOST_SLOTS}")
    if not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct, at least one and no more than slots")
    at, steps = zip(*(preference(s, slots) for s in shards), strict=True)
    at, table, left = list(at), [-1] * slots, slots
    while left:
        for i, step in enumerate(steps):
            while table[at[i]] >= 0:
                at[i] = (at[i] + step) % slots
            table[at[i]] = i
            left -= 1
            if not left:
                break
    return table


def slot(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: its text's MD5, the first eight hex digits, modulo the number of slots; null is the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(slots)).cast("int")


def lookup_table(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """(slot int, shard string), one row a slot."""
    owners = ",".join(map(str, fill(shards, slots)))
    names = F.array(*map(F.lit, shards))
    rows = spark.range(1, numPartitions=1).select(F.posexplode(F.split(F.lit(owners), ",")).alias("slot", "owner"))
    return rows.select("slot", F.element_at(names, F.col("owner").cast("int") + 1).alias("shard"))


def with_shard(df: DataFrame, key: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """``df`` with slot int and shard string by its column ``key``; all other columns stay, these two are replaced.

    ``key`` may be one of the two. Rows of equal keys are on one shard, a null key is placed as the empty text is, and
    rows repeat as they do in ``df``. No row is shuffled.
    """
    own = free_name(df, "slot")
    table = lookup_table(df.sparkSession, shards, slots).withColumnRenamed("slot", own)
    df = df.withColumn(own, slot(F.col(f"`{key}`"), slots)).drop("slot", "shard")
    kept = [F.col(f"`{c}`") for c in df.columns if c != own]
    return df.join(F.broadcast(table), own).select(*kept, F.col(own).alias("slot"), "shard")


def write_shards(df: DataFrame, key: str, path: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> None:
    """Writes ``df`` as Parquet, a folder for each shard. Adaptive rebalancing splits a shard that holds many rows of one key."""
    placed = with_shard(df, key, shards, slots)
    placed.hint("rebalance", "shard").write.partitionBy("shard").parquet(path)


#: Placement in DuckDB SQL; {key}, {columns}, {table}, {shards} and {slots} are filled in.
ORACLE = """
WITH RECURSIVE names AS (
  SELECT i, 'shard-' || lpad(i::VARCHAR, 2, '0') AS shard FROM range({shards}) r(i)
), prefs AS (
  SELECT i, shard, ('0x' || md5('offset:' || shard)[1:8])::BIGINT % {slots} AS first,
    ('0x' || md5('skip:' || shard)[1:8])::BIGINT % ({slots} - 1) + 1 AS step FROM names
), turns(slot, turn, owner) USING KEY (slot) AS (
  SELECT first::BIGINT, 0::BIGINT, 0::BIGINT FROM prefs WHERE i = 0
  UNION
  SELECT arg_min(x.slot, x.j), min(x.turn), min(x.owner) FROM (
    SELECT (p.first + j * p.step) % {slots} AS slot, l.turn + 1 AS turn, p.i::BIGINT AS owner, j
    FROM (SELECT max(turn) AS turn FROM recurring.turns) l JOIN prefs p ON p.i = (l.turn + 1) % {shards}, range({slots}) r(j)
    WHERE l.turn + 1 < {slots}
  ) x WHERE NOT EXISTS (SELECT 1 FROM recurring.turns t WHERE t.slot = x.slot)
  HAVING count(*) > 0
)
SELECT {columns}, d.slot::INT AS slot, n.shard
FROM (SELECT *, ('0x' || md5(coalesce({key}::VARCHAR, ''))[1:8])::BIGINT % {slots} AS slot FROM {table}) d
JOIN turns t ON t.slot = d.slot JOIN names n ON n.i = t.owner
"""
