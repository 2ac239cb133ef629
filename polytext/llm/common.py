"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polytext.session import release, stored

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python
    tasks can import it wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="polytext-"), "polytext_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``stored`` that nothing reads any more, so that a long
    job holds only the tables it still needs."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def held_out(doc_id: Column) -> Column:
    """True for rows whose label is never learned: crc32(doc_id as text) mod 5 = 0.
    A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def known_labels(labels: DataFrame, label: str, limit: int | None = None) -> DataFrame:
    """``doc_id, y`` a classifier may learn from: one label per id (the larger
    one if an id is labelled twice), not held out, label 0 or 1.  With a limit,
    the ids with the smallest hash: the same rows at any partitioning."""
    known = (labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("y")))
    if limit is not None:
        known = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))  # at most ``limit`` ids
    return known


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, limit: int | None = None) -> DataFrame:
    """``doc_id, text, y`` of the known labels' documents."""
    return docs.select("doc_id", "text").join(known_labels(labels, label, limit), "doc_id")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): ``node, root`` for each node,
    by randomised contraction.  In each round every node joins the neighbour
    (or itself) with the smallest hash for that round, and edges are rewritten
    between the chosen nodes; the number of rounds grows with the logarithm of
    the nodes.  All tables stay distributed and are written between rounds."""
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        mark = lambda c, seed=len(maps): F.struct(F.xxhash64(F.col(c), F.lit(seed)).alias("h"), F.col(c).alias("n"))
        both = edges.select("a", mark("b").alias("m")).union(edges.select(F.col("b"), mark("a")))
        own = both.groupBy("a").agg(F.min("m").alias("m")).select(F.col("a").alias("node"), F.least("m", mark("a"))["n"].alias("root"))
        own = stored(own, "contraction")
        left, right = (own.select(F.col("node").alias(c), F.col("root").alias(f"to_{c}")) for c in "ab")
        edges = edges.join(left, "a").join(right, "b").where("to_a <> to_b")
        edges = stored(edges.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
        maps.append(own)
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps.pop()
    while maps:
        later = out.select(F.col("node").alias("root"), F.col("root").alias("end"))
        out = maps.pop().join(later, "root", "left").select("node", F.coalesce("end", "root").alias("root"))
    return out
