"""op6_sentencepiece and the tokens stage take their pieces with spans."""

from __future__ import annotations

import hashlib

import corpus_pipeline
import sentencepiece
from llm_data import SF001
from polytext.llm import queries as Q


def test_spans_of_the_registered_uses_match_the_library(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=Q.tokenizer())
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    want = {}
    for r in docs.collect():
        said = [(x.begin, x.end) for x in lib.encode(r["text"], return_type="proto").pieces]
        want[r["doc_id"]] = hashlib.sha256(",".join(f"{a}-{b}" for a, b in said).encode()).hexdigest()
    byte = {i for i in range(lib.get_piece_size()) if lib.is_byte(i)}  # the library gives these spans of its own
    plain = {r["doc_id"] for r in docs.collect() if not byte & set(lib.encode(r["text"]))}
    assert plain
    for out in (Q.QUERIES["op6_sentencepiece"](spark, SF001), corpus_pipeline.tokens(spark, docs, SF001)):
        got = {r["doc_id"]: r["spans_sha256"] for r in out.collect()}
        assert got.keys() == want.keys() and all(got[i] == want[i] for i in plain)
