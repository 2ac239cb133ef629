"""Deterministic hash-based randomness.

Every sampled, shuffled or padded result in the engine draws its randomness from
``uniform(key..., seed)``: the first 32 bits of ``md5(key|...|seed)`` scaled to
[0, 1).  The value depends only on the row's natural key, so a task retry, a
lost executor or a different number of partitions gives the same answer, and
DuckDB computes the identical double (integer / 2**32 is exact).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _key(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def hash_u32(*parts) -> Column:
    """First 32 bits of md5 over the '|'-joined parts, as a bigint."""
    return F.conv(F.substring(F.md5(_key(*parts)), 1, 8), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """Uniform double in [0, 1) keyed by the given columns / literals."""
    return hash_u32(*parts) / F.lit(TWO_32)


def uniform_int(n: Column, *parts) -> Column:
    """Uniform integer in [0, n) (n > 0), computed in integers."""
    return F.floor(hash_u32(*parts) * n.cast("bigint") / F.lit(TWO_32)).cast("bigint")


# ---- DuckDB text of the same functions (used by oracle SQL) ----

def sql_key(*parts: str) -> str:
    return "concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"


def sql_hash_u32(*parts: str) -> str:
    return f"CAST(('0x' || substr(md5({sql_key(*parts)}), 1, 8)) AS BIGINT)"


def sql_uniform(*parts: str) -> str:
    return f"({sql_hash_u32(*parts)} / 4294967296.0)"


def sql_uniform_int(n: str, *parts: str) -> str:
    return f"CAST(floor({sql_hash_u32(*parts)} * CAST({n} AS BIGINT) / 4294967296.0) AS BIGINT)"
