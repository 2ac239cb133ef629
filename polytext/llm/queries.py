"""Queries of this subpackage over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from polytext.llm import decontam, infill, jaccard, minhash, phrases, pieces, pii, quality, sharding, suffixes, topk, toxicity, urls
from polytext.llm.common import read, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


@_query(sharding.SQL)
def op1_sharding(spark, sf_dir):
    return sharding.place(read(spark, sf_dir, "documents"), "doc_id", sharding.names())


@_query()
def op2_jaccard(spark, sf_dir):
    return jaccard.link(read(spark, sf_dir, "documents"))


@_query()
def op3_pii(spark, sf_dir):
    return pii.digest(read(spark, sf_dir, "documents"))


@_query()
def op4_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


@_query()
def op5_url_filter(spark, sf_dir):
    return urls.judge(read(spark, sf_dir, "pages"))


@_query()
def op6_sentencepiece(spark, sf_dir):
    return pieces.digest(read(spark, sf_dir, "documents"), tokenizer(), spans=True)


@_query()
def op7_suffixes(spark, sf_dir):
    return suffixes.remove(read(spark, sf_dir, "documents"), with_text=False)


@_query()
def op8_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


@_query(decontam.SQL)
def op9_decontamination(spark, sf_dir):
    return decontam.digest(decontam.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


@_query(topk.SQL)
def op10_top_k(spark, sf_dir):
    return topk.top_k(read(spark, sf_dir, "embeddings"))


@_query(phrases.SQL)
def op11_phrases(spark, sf_dir):
    return phrases.mine(read(spark, sf_dir, "documents"))


@_query()
def op12_minhash(spark, sf_dir):
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


@_query(infill.SQL)
def op13_infill(spark, sf_dir):
    return infill.digest(infill.infill(read(spark, sf_dir, "documents")))
