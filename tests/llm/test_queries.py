from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as E
from llm_data import SF001
from polytext.llm import queries as Q
from tools.check_oracle import TABLES, digest


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    df = Q.QUERIES[name](spark, SF001)
    res = con.sql(Q.ORACLE[name])
    assert sorted(df.columns) == sorted(res.columns)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(res.columns, res.fetchall())[0]


def test_every_operator_is_registered():
    names = E.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
    assert "pipeline" in names


@pytest.mark.parametrize("name", ["op4_toxicity", "op8_quality", "op3_pii", "op6_sentencepiece"])
def test_one_row_for_each_document(spark, name):
    df = Q.QUERIES[name](spark, SF001)
    assert df.count() == spark.read.parquet(f"{SF001}/documents.parquet").count()
