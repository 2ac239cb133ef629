"""The orthography fix on texts that need it (B2), through the cleaning of tuples (B1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from polytext.operators import tuples as TU


def test_apostrophes_leave_livonian_texts_but_those_with_the_kept_mark(spark):
    rows = [(1, {"liv": "ro’z u’m", "est": "see’p"}), (2, {"liv": "O’R ja mu’u", "liv-dia": "a’b"}), (3, {"liv": "plain"}), (4, {"liv": "’"})]
    df = spark.createDataFrame(rows, "id long, m map<string,string>").select("id", TU.clean_tuple(F.col("m")).alias("m"))
    got = {r["id"]: r["m"] for r in df.collect()}
    assert got == {1: {"liv": "roz um", "est": "see’p"}, 2: {"liv": "O’R ja mu’u", "liv-dia": "a’b"}, 3: {"liv": "plain"}, 4: {"liv": ""}}
