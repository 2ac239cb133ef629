"""Golden rows for the QC label (C1), language rules (B17, B18, D4, H3) and the
script check (C6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from polytext.functions import langs as L
from polytext.operators import qc


def _label(spark, src, tgt, tgt_lang="English", det="en"):
    df = spark.createDataFrame([(src, tgt, tgt_lang, det)], "s string, t string, l string, d string")
    return df.select(qc.pair_qc_label("s", "t", "l", "d").alias("x")).first().x


def test_qc_ratio_boundary(spark):
    assert _label(spark, "abc", "a") == "ok"          # ratio exactly 3 is allowed
    assert _label(spark, "abcd", "a") == "ratio"      # 3 + 1 characters is not
    assert _label(spark, "a", "abcd") == "ratio"


def test_qc_order_and_labels(spark):
    assert _label(spark, "same text", "same text") == "eq"
    assert _label(spark, "what?", "wha") == "ans"
    assert _label(spark, "what?", "what??") == "ok"
    t60 = "x" * 60
    assert _label(spark, t60, t60[:-1] + "y", det="fr") == "ok"          # 60 chars: detector ignored
    assert _label(spark, t60 + "a", t60 + "b", det="xx") == "lid-tgt xx"  # 61 chars: counts
    assert _label(spark, "", "abc") == "empty"
    assert _label(spark, "abc", "") == "empty"
    assert _label(spark, "abc", "abd", tgt_lang="Klingon") == "lid-skip"


def test_generic_language_rules(spark):
    df = spark.createDataFrame([("Estonian, ocr",), ("Estonian, Hiiu",), ("Livonian, Standard",), ("Klingon",)],
                               "l string")
    rows = df.select("l", L.gen_lang_metric("l").alias("m"), L.gen_lang_synth("l").alias("s"),
                     L.resource_tier("l").alias("t"), L.resource_multiplier("l").alias("k")).collect()
    got = {r.l: (r.m, r.s, r.t, r.k) for r in rows}
    assert got["Estonian, ocr"] == ("Estonian", "Estonian", "high", 2)
    assert got["Estonian, Hiiu"] == ("Estonian", "Estonian, Hiiu", "high", 2)
    assert got["Livonian, Standard"] == ("Livonian", "Livonian", "xlow", 6)
    assert got["Klingon"] == ("Klingon", "Klingon", "?", 2)


def test_script_check(spark):
    rows = [("abcdefg", "est_Latn"), ("abcdefgйцу", "est_Latn"), ("1234", "rus_Cyrl"), ("абв", "rus_Cyrl"),
            ("<dia> абв", "est_Latn"), ("ёёё", "rus_Cyrl"), ("abc", "xx")]
    df = spark.createDataFrame(rows, "t string, c string")
    got = [(r.s, r.f) for r in df.select(qc.text_script("t").alias("s"), qc.is_fishy("t", "c").alias("f")).collect()]
    # 7 latin of 10 letters is exactly 0.7 -> mix
    assert got == [("latn", False), ("mix", True), (None, False), ("cyrl", False), ("cyrl", True), (None, False),
                   ("latn", True)]
