"""Skew-safe equi-joins.

``salted_join`` spreads every key of the large side over ``salts`` buckets
(keyed by a hash of a per-row column, so the split is deterministic) and
replicates the small side once per bucket.  A key that holds a third of all
rows (a frequent token or trigram) is then processed by ``salts`` tasks
instead of one; the small side grows by the factor ``salts`` only.  Each
large row meets exactly one copy of its match, so inner, left-outer, semi and
anti results are unchanged.  The replicated side is never broadcast: Spark
estimates an exploded table as large as it was before, and from compressed files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_SALTS = 8


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salt_by: Column | None = None,
                salts: int = DEFAULT_SALTS) -> DataFrame:
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("salted_join supports inner, left, left_semi and left_anti joins")
    key = salt_by if salt_by is not None else F.monotonically_increasing_id()
    b = big.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int"))
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return b.join(s.hint("merge"), [*on, "_salt"], how).drop("_salt")


# A key of more rows than this is spread over several tasks by ``hot_join``.
HOT_ROWS = 50_000


def hot_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salt_by: Column | None = None,
             salts: int = DEFAULT_SALTS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """As ``salted_join``, for a small side with long rows: only the keys that
    ``hot_rows`` rows of the large side share are spread, so that of the others
    one copy is shuffled.  The large side is read twice; its keys are counted
    first, and the hot ones (at most its rows / ``hot_rows``) are broadcast."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("hot_join supports inner, left, left_semi and left_anti joins")
    key = salt_by if salt_by is not None else F.monotonically_increasing_id()
    hot = F.broadcast(big.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(*on, F.lit(True).alias("_hot")))
    b = big.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")).join(hot, on, "left")
    b = b.withColumn("_salt", F.when(F.col("_hot"), F.col("_salt")).otherwise(0)).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    s = small.join(hot, on, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return b.join(s, [*on, "_salt"], how).drop("_salt")


# A lookup table is broadcast only below this many bytes (measured first);
# beyond it the salted shuffle join is used.
MAX_BROADCAST_BYTES = 64 << 20


def table_bytes(df: DataFrame) -> int:
    """Bytes of a table's rows: 8 for each column, and the lengths of strings,
    binaries and (as JSON) nested values.  One aggregate over the table."""
    size = F.lit(8 * len(df.columns))
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif kind in ("array", "map", "struct"):
            size = size + F.coalesce(F.octet_length(F.to_json(f.name)), F.lit(0))
    return df.agg(F.sum(size)).first()[0] or 0


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
                salt_by: Column | None = None, max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
                salts: int = DEFAULT_SALTS) -> DataFrame:
    """Join a large table to a lookup table (vocabulary, model, dev set).

    The lookup side's bytes are measured first (one aggregate; callers pass
    tables that are materialised or cheap): below ``max_broadcast_bytes`` it
    is broadcast -- no shuffle of the large side, so hot keys cost nothing --
    otherwise the join is salted so a hot key is spread over ``salts`` tasks.
    """
    if table_bytes(small) <= max_broadcast_bytes:
        return big.join(F.broadcast(small), on, how)
    return salted_join(big, small, on, how, salt_by=salt_by, salts=salts)


# A bit table has this many bits (8 MB), whatever the keys.
TABLE_BITS = 1 << 26


def _key_hash(on: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(bits))


def bit_table(small: DataFrame, on: list[str], bits: int = TABLE_BITS) -> DataFrame:
    """The key hashes of a lookup table as bitmaps (_bucket, _bits): one row of
    4 KB for each 32,768 bits, so its size is bounded however many keys there are."""
    h = _key_hash(on, bits)
    return small.select(F.bitmap_bucket_number(h).alias("_bucket"), F.bitmap_bit_position(h).alias("_at")).groupBy("_bucket").agg(
        F.bitmap_construct_agg("_at").alias("_bits"))


def may_match(big: DataFrame, table: DataFrame, on: list[str], flag: str, bits: int = TABLE_BITS) -> DataFrame:
    """``big`` with a boolean ``flag``: false where the key is surely not in the
    lookup table behind ``table`` (a ``bit_table`` of as many bits, its key columns in
    the same order), true where it is or its hash meets another key's.  No row is shuffled."""
    h = _key_hash(on, bits)
    at = F.bitmap_bit_position(h)
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    out = big.withColumn("_bucket", F.bitmap_bucket_number(h)).join(F.broadcast(table), "_bucket", "left")
    return out.withColumn(flag, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("_bucket", "_bits")


def sparse_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Join of a table with long rows to keys (and more columns) that few of them
    have, inner, left_semi or left_anti.  The keys are broadcast up to so many bytes
    (measured; callers pass a written table); beyond it a bit table keeps the rows
    out of the shuffle that surely have no match.  A key's rows meet in one task."""
    if how not in ("inner", "left_semi", "left_anti"):
        raise ValueError("sparse_join supports inner, left_semi and left_anti joins")
    if table_bytes(small) <= max_broadcast_bytes:
        return big.join(F.broadcast(small), on, how)
    flagged = may_match(big, bit_table(small, on), on, "_may")
    out = flagged.where("_may").drop("_may").join(small, on, how)
    return out.unionByName(flagged.where(~F.col("_may")).select(out.columns)) if how == "left_anti" else out
