"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table (an offset and a step taken from
digests of its name). Shards take turns, each claiming the first free slot of its permutation, until the
table is full. A row is placed by one digest of its key and one look into the table, so placement costs
the same for any number of shards, and when a shard joins or leaves, few slots change hands.

Defined results: a null key is placed as the text "null key"; repeated rows go to the same shard; an empty
input gives an empty output; every other column is kept. The columns `slot` and `shard` are added; an input
column of that name is replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

SHARDS = 64
SLOTS = 6421  # prime; about 100 slots a shard keep shares within a per cent or so
NULL_KEY = "null key"


def digest(text: str) -> int:
    """The first 60 bits of MD5, as SQL engines give it too."""
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard number of each slot. Its size is the parameter `slots`, whatever the data."""
    if not is_prime(slots) or slots < len(shards) or not shards:
        raise ValueError("slots must be a prime that is no less than the number of shards")
    at = [digest(f"offset:{s}") % slots for s in shards]
    step = [digest(f"step:{s}") % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while left:
        for k in range(len(shards)):
            if not left:
                break
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            table[at[k]] = k
            left -= 1
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """A row's slot: digest of its key, modulo the table's size."""
    text = F.coalesce(key.cast("string"), F.lit(NULL_KEY))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % F.lit(slots)


def place(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """df with `slot` (long) and `shard` (string), which replace columns of these names. The table has `slots` rows and is broadcast."""
    (k,), at, name = shared.columns([key]), shared.fresh(df, "__slot"), shared.fresh(df, "__shard")
    table = df.sparkSession.createDataFrame(list(enumerate(shards[x] for x in fill_table(shards, slots))), f"{at} long, {name} string")
    out = df.withColumn(at, slot_of(k, slots)).join(F.broadcast(table), at)
    rest = shared.columns([c for c in df.columns if c.lower() not in ("slot", "shard")])
    return out.select(*rest, F.col(at).alias("slot"), F.col(name).alias("shard"))


def names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:03d}" for i in range(n)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(shared.documents(spark, sf_dir).select("doc_id"), "doc_id", names())


def oracle() -> str:
    """DuckDB fills the table again, turn by turn, in a recursive query, and places the rows."""
    return f"""
WITH RECURSIVE shard AS (
  SELECT i AS k, 'shard-' || lpad(i::VARCHAR, 3, '0') AS name FROM range({SHARDS}) t(i)
), perm AS (
  SELECT k, name, ('0x' || substr(md5('offset:' || name), 1, 15))::BIGINT % {SLOTS} AS first,
         ('0x' || substr(md5('step:' || name), 1, 15))::BIGINT % {SLOTS - 1} + 1 AS step FROM shard
), start AS (
  SELECT list(first ORDER BY k) AS at0, list(step ORDER BY k) AS steps FROM perm
), fill(turn, taken, slot) AS (
  SELECT 0, [false FOR x IN range({SLOTS})], -1::BIGINT FROM start
  UNION ALL
  SELECT turn + 1, list_concat(taken[:s], [true], taken[s + 2:]), s
  FROM (SELECT turn, taken, list_extract(list_filter(
          list_transform(range({SLOTS}), lambda j: (at0[turn % {SHARDS} + 1] + j * steps[turn % {SHARDS} + 1]) % {SLOTS}),
          lambda p: NOT taken[p + 1]), 1) AS s
        FROM fill, start WHERE turn < {SLOTS})
), placed AS (
  SELECT slot, (turn - 1) % {SHARDS} AS k FROM fill WHERE turn > 0
)
SELECT d.doc_id, p.slot, s.name AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '{NULL_KEY}')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents) d
JOIN placed p ON p.slot = d.slot JOIN shard s ON s.k = p.k
"""
