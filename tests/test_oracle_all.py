"""Every registered query against its DuckDB oracle on the smallest tables
(row count, column names, order-insensitive values)."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from polytext.plans import registry
from tools.check_oracle import TABLES, digest

SF = "/root/testdata/sf0.001"
_SQL = registry.oracle_sql()
_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
_Q = registry.queries()


@pytest.fixture(scope="module")
def duck_all():
    import os

    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_every_query_is_registered_with_an_oracle_or_is_iterative():
    no_oracle = set(_Q) - set(_SQL)
    assert no_oracle <= {"learn_subword_vocab"}, no_oracle
    assert set(_SQL) <= set(_Q)


@pytest.mark.parametrize("name", sorted(_SQL))
def test_query_matches_oracle(spark, duck_all, name):
    df = _Q[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    res = duck_all.sql(_SQL[name])
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(res.columns)
    assert len(srows) == len(orows)
    assert digest(df.columns, srows)[0] == digest(res.columns, orows)[0]
    spark_types = {f.name: _TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    duck_types = dict(zip(res.columns, [str(t) for t in res.types]))
    assert spark_types == duck_types


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"lp", "n_rows", "bleu", "chrf"}
