"""Sharding by a permutation-filled lookup table.

Each shard prefers the slots of a table of prime size in an order of its own,
``(offset + j * skip) mod size``.  The shards take turns in order of their
names; at its turn a shard claims the first slot it prefers that is free.  The
finished table gives a row its shard in constant time, ``table[hash mod
size]``; loads differ by one slot at most, and taking a shard away moves few
rows of the others.

Scale: rows are placed by a broadcast join on the slot, without any shuffle;
the table has ``size`` rows, a parameter that is checked against ``MOST``.

Edge cases: a null key is placed as the empty string; equal keys always share
a shard, so repeated rows stay together; an empty input gives no rows; names
are used once each, and an empty list of shards is an error.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST = 1 << 22
N_SHARDS, SIZE = 64, 6553


def _number(said: str) -> int:
    return int(hashlib.md5(said.encode("utf-8")).hexdigest()[:15], 16)


def fill(shards: list[str], size: int) -> list[int]:
    """Index of the shard (in the given order) that owns each slot."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    if size > MOST or size < len(shards) or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError(f"the table's size must be a prime of at least the number of shards and at most {MOST}")
    at = [_number(f"offset|{s}") % size for s in shards]
    skip = [_number(f"skip|{s}") % (size - 1) + 1 for s in shards]
    table = [-1] * size
    for turn in range(size):
        i = turn % len(shards)
        while table[at[i]] >= 0:
            at[i] = (at[i] + skip[i]) % size
        table[at[i]] = i
    return table


def slot(key: Column, size: int) -> Column:
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.conv(digits, 16, 10).cast("long") % size


def lookup_table(spark: SparkSession, shards: list[str], size: int) -> DataFrame:
    return spark.createDataFrame([(i, shards[s]) for i, s in enumerate(fill(shards, size))], "slot long, shard string")


def place(rows: DataFrame, key: str, shards: list[str], size: int = SIZE) -> DataFrame:
    """``key``, slot and shard of each row."""
    table = lookup_table(rows.sparkSession, shards, size)
    return rows.select(F.col(key)).withColumn("slot", slot(F.col(key), size)).join(F.broadcast(table), "slot", "left").select(key, "slot", "shard")


def names(n: int = N_SHARDS) -> list[str]:
    return [f"shard-{i:03d}" for i in range(n)]


#: Claims one slot a step; the state holds each shard's next slot and the owners so far.
SQL = f"""
WITH RECURSIVE s AS (SELECT i, 'shard-' || lpad(CAST(i AS VARCHAR), 3, '0') AS name FROM range({N_SHARDS}) r(i)),
p AS (SELECT list(CAST('0x' || substr(md5('offset|' || name), 1, 15) AS BIGINT) % {SIZE} ORDER BY i) AS o,
             list(CAST('0x' || substr(md5('skip|' || name), 1, 15) AS BIGINT) % {SIZE - 1} + 1 ORDER BY i) AS k FROM s),
t(n, slot, owner) AS (
  SELECT 0, o, list_transform(range({SIZE}), lambda x: -1) FROM p
  UNION ALL
  SELECT n + 1,
         list_transform(slot, lambda x, i: CASE WHEN i = n % {N_SHARDS} + 1 THEN c ELSE x END),
         owner[1:c] || [n % {N_SHARDS}] || owner[c + 2:]
  FROM (SELECT t.*, (slot[n % {N_SHARDS} + 1] + k[n % {N_SHARDS} + 1] *
          (list_position(list_transform(range({SIZE}), lambda j: owner[(slot[n % {N_SHARDS} + 1] + k[n % {N_SHARDS} + 1] * j) % {SIZE} + 1]), -1) - 1)) % {SIZE} AS c
        FROM t, p WHERE n < {SIZE})),
f AS (SELECT owner FROM t WHERE n = {SIZE}),
m AS (SELECT unnest(range({SIZE})) AS slot, unnest(owner) AS i FROM f)
SELECT doc_id, slot, name AS shard
FROM (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SIZE} AS slot FROM documents)
JOIN m USING (slot) JOIN s USING (i)
"""
