"""The corpus pipeline: quality, near duplicates, benchmark passages, personal
data, tokens.

``STAGES`` lists (name, function).  A function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs.  All but the last return the columns of ``documents``:

1. ``quality``: documents with a score below 0.3 go;
2. ``near_duplicates``: of documents linked by 5-word shingles (similarity of
   0.8 or more) the one with the smallest id stays (of several texts with that
   id, the one with the smallest digest); rows of one id with other texts are
   judged by their own links; documents without words stay;
3. ``decontamination``: documents in which a benchmark window occurs go;
4. ``personal_data``: spans are replaced by their kind, ``n_chars`` follows;
5. ``tokens``: ids of each text, the digest of the text they decode to and that
   of their byte spans.

Nulls: a null text counts as empty and stays null up to the last stage; rows
with a null doc_id are never linked.  Rows that repeat an id and its text are
one document: one of them stays in stage 2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polytext.llm import decontam, jaccard, pieces, pii
from polytext.llm import quality as classifier
from polytext.llm.common import read, ship, stored
from polytext.llm.queries import tokenizer
from polytext.operators.joins import MAX_BROADCAST_BYTES, bit_table, may_match, table_bytes


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trees = classifier.fit(docs, read(spark, sf_dir, "labels"))
    return docs.where(classifier.score(F.col("text"), trees) >= classifier.KEEP)


def without(docs: DataFrame, gone: DataFrame, on: list[str], most: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs`` whose key is not in ``gone``.  No text is shuffled where
    the keys fit a broadcast of ``most`` bytes (measured); beyond it a bit table
    lets only rows whose key may be there through to the shuffled join."""
    if table_bytes(gone) <= most:
        return docs.join(F.broadcast(gone), on, "left_anti").select(docs.columns)
    flagged = may_match(docs, bit_table(gone, on), on, "_may")
    return flagged.where(~F.col("_may")).select(docs.columns).unionByName(
        flagged.where("_may").join(gone, on, "left_anti").select(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = stored(jaccard.link(docs, k=5, percent=80, by_text=True).where("n_shingles > 0 and doc_id is not null").withColumn("text_key", F.struct("class", "text_hash")), "linked")
    gone = rows.where("component_id <> doc_id").select("doc_id", "text_hash")
    docs = docs.withColumn("_text", F.xxhash64("text"))
    repeated = not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    if repeated:  # several texts of a component's smallest id: the smallest digest stays
        least = rows.where("component_id = doc_id")
        tied = least.groupBy("root").agg(F.min("text_key").alias("_first"), F.max("text_key").alias("_last")).where("_first <> _last")
        gone = gone.union(least.join(tied, "root").where("text_key <> _first").select("doc_id", "text_hash"))
    kept = without(docs, gone.distinct().withColumnRenamed("text_hash", "_text"), ["doc_id", "_text"])
    if repeated:
        kept = kept.where("doc_id is null").unionByName(kept.where("doc_id is not null").dropDuplicates(["doc_id", "_text"]))
    return kept.drop("_text")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    changed = docs.withColumn("text", pii.redacted(F.col("text")))
    return changed.withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encoded(docs, tokenizer(), ["doc_id", "lang", "source"])


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("tokens", tokens)]

#: Trees, components and pieces are not expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
