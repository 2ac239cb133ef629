"""Exact top-k search by inner product, with pivot-table elimination.

Components become ``floor(256 * x)``; the score is the integer inner product.
With one more component, ``sqrt(M - |x|^2)`` for rows (M: the largest squared
norm) and 0 for queries, the largest product is the smallest distance, so the
triangle inequality holds: ``|d(q, p) - d(x, p)| <= d(q, x)`` for each pivot p.
The table of distances to all pivots is computed once and stored.  For each
query the largest of these differences bounds a row from below; rows are
evaluated in the order of their bound until the bound exceeds the k-th
distance found.  Bounds are compared with a slack above rounding errors, and
rows that tie are evaluated, so the result is exact; ties go to the smaller
vec_id.

Scale: rows stay where they are; a task evaluates its rows in blocks of
``ROWS`` and returns k rows a query, and the k best of all tasks are taken by
a window with a group limit before its shuffle.  Queries are dealt in blocks
of at most ``block`` queries (a stated query set against all rows, in blocks):
only one block is at the driver and in a broadcast at a time; its results are
written before the next one.  Pivots are far
points chosen from a bounded sample (``PIVOT_SAMPLE`` rows, by hash); they
affect speed only.

Edge cases: vectors that are null, empty, or hold null or non-finite
components take no part; rows with a null vec_id take no part; vectors of
another length than the query's are not its candidates; a candidate with the
query's own vec_id is left out; a repeated row (equal vec_id and vector)
counts once; fewer than k candidates give fewer rows; products beyond 53 bits
are computed with Python's integers and held at the ends of a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polytext.llm.common import ship, stored

PIVOTS, PIVOT_SAMPLE, ROWS = 32, 2048, 4096
TABLE = "vec_id long, v array<double>, sq double, d array<double>"
FOUND = "query_id long, vec_id long, score long"
_LONG = 2**63


def whole(vectors: DataFrame) -> DataFrame:
    """vec_id and v, the floored components, of the vectors that take part."""
    x = vectors.select("vec_id", F.transform("embedding", lambda c: c.cast("double")).alias("x"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (x.where(F.col("vec_id").isNotNull() & (F.size("x") > 0) & ~bad)
            .select("vec_id", F.transform("x", lambda c: F.floor(c * 256).cast("double")).alias("v")))


def far_points(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` points of the sample, each the farthest from those before."""
    picked, near = [], np.full(len(sample), np.inf)
    while len(picked) < min(n, len(sample)) and (not picked or near.max() > 0):
        picked.append(int(near.argmax()))
        near = np.minimum(near, ((sample - sample[picked[-1]]) ** 2).sum(axis=1))
    return sample[picked]


def _distances(v: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    full = np.concatenate([v, extra[:, None]], axis=1)
    return np.sqrt(((full[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2))


def scores(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``v`` with ``q``."""
    if float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * len(q) < 2**53:
        return (v @ q).astype(np.int64)
    said = [sum(int(a) * int(b) for a, b in zip(r, q)) for r in v]
    return np.array([max(-_LONG, min(_LONG - 1, s)) for s in said], dtype=np.int64)


def search_block(ids: np.ndarray, v: np.ndarray, d: np.ndarray, top: float, queries, k: int) -> Iterator[tuple[int, int, int]]:
    """The k best rows of a block for each query (id, vector, distances)."""
    for qid, q, qd in queries:
        bound = np.abs(d - qd).max(axis=1) if d.shape[1] else np.zeros(len(v))
        order = np.argsort(bound, kind="stable")
        low = bound[order]
        size = float(q @ q) + top
        got_s, got_i, at, step = np.empty(0, np.int64), np.empty(0, np.int64), 0, 256
        while at < len(order):
            if len(got_s) >= k:
                kth = np.sqrt(max(0.0, size - 2.0 * float(got_s[k - 1])))
                if low[at] > kth * (1 + 1e-9) + 1e-6 * (1 + np.sqrt(size)):
                    break  # no row further on can be among the k best
            part = order[at:at + step]
            part = part[ids[part] != qid]
            got_s, got_i = np.concatenate([got_s, scores(v[part], q)]), np.concatenate([got_i, ids[part]])
            best = np.lexsort((got_i, ~got_s))[:k] if len(got_s) else []  # ~s: descending and without overflow
            got_s, got_i = got_s[best], got_i[best]
            at += step
        for s, i in zip(got_s.tolist(), got_i.tolist()):
            yield qid, i, s


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each vector
    whose vec_id is divisible by ``every``."""
    spark = vectors.sparkSession
    ship(spark)
    rows = whole(vectors).distinct()
    found, best = None, Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    for size in [r[0] for r in rows.select(F.size("v")).distinct().collect()]:  # one length, in a sound table
        own = rows.where(F.size("v") == size)
        sq = F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c)
        top = own.agg(F.max(sq)).first()[0]
        sample = np.array([r[0] for r in own.orderBy(F.xxhash64("vec_id")).limit(PIVOT_SAMPLE).select("v").collect()])
        extra = np.sqrt(np.maximum(0, top - (sample**2).sum(axis=1)))
        pivots = far_points(np.concatenate([sample, extra[:, None]], axis=1), PIVOTS)

        def distances(parts: Iterator[pd.DataFrame], top=top, pivots=pivots) -> Iterator[pd.DataFrame]:
            for p in parts:
                for i in range(0, len(p), ROWS):
                    part = p.iloc[i:i + ROWS]
                    v = np.stack(part["v"].to_numpy())
                    sq = (v**2).sum(axis=1)
                    yield pd.DataFrame({"vec_id": part["vec_id"], "v": part["v"], "sq": sq, "d": list(_distances(v, np.sqrt(np.maximum(0, top - sq)), pivots))})

        table = stored(own.mapInPandas(distances, TABLE), "pivot-table")
        queries = table.where(F.col("vec_id") % every == 0)
        blocks = max(1, -(-queries.count() // block))
        for b in range(blocks):
            part = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).select("vec_id", "v")
            asked = [(r[0], np.array(r[1])) for r in part.toLocalIterator()]
            asked = [(i, q, _distances(q[None], np.zeros(1), pivots)[0]) for i, q in asked]
            shared = spark.sparkContext.broadcast(asked)  # about ``block`` vectors

            def search(parts: Iterator[pd.DataFrame], top=top, shared=shared) -> Iterator[pd.DataFrame]:
                for p in parts:
                    for i in range(0, len(p), ROWS):
                        part = p.iloc[i:i + ROWS]
                        got = search_block(part["vec_id"].to_numpy(), np.stack(part["v"].to_numpy()), np.stack(part["d"].to_numpy()), top, shared.value, k)
                        yield pd.DataFrame(got, columns=["query_id", "vec_id", "score"])

            near = table.select("vec_id", "v", "d").mapInPandas(search, FOUND)
            near = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            if blocks > 1:
                near = stored(near, "found")
                shared.destroy()
            found = near if found is None else found.union(near)
    if found is None:
        found = spark.createDataFrame([], FOUND)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
