"""Golden rows: prompts, language codes, the two docstring
records, batching edge sizes, short token arrays."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from polytext.functions import codes as CD
from polytext.functions import langs as L
from polytext.functions import prompts as P
from polytext.operators import batching as BA
from polytext.operators import synth


def test_prompt_special_characters(spark):
    rows = [("translate", "a {x} $1 \\ b", None, "Estonian", "English"),
            ("translate", "src", "", "Estonian", "English"),
            ("approx-translate", "src", "tgt $2", "Estonian", "English"),
            ("generate", "mono", None, "Võro", None)]
    df = spark.createDataFrame(rows, "task string, src_segm string, tgt_segm string, src_lang string, "
                                     "tgt_lang string")
    got = [r.p for r in df.select(P.prompt_mt_train().alias("p")).collect()]
    t12, t13, t14, t15 = (f"<|reserved_special_token_{i}|>" for i in (12, 13, 14, 15))
    assert got[0] == f"{t12}a {{x}} $1 \\ b{t13}Estonian"             # NULL target -> mono template
    assert got[1] == f"{t12}src{t13}Estonian"                          # blank target -> mono template
    assert got[2] == f"{t12}src{t13}Estonian{t14}approx-translate to English{t15}tgt $2"
    assert got[3] == f"{t12}mono{t13}Võro"
    inf = df.select(P.prompt_mt_inference().alias("p")).collect()[3].p
    assert inf.endswith("generate to None" + t15)                      # Python renders None


def test_pivot_prompt_docstring_record(spark):
    rec = {"lo_lang": "Livonian, Standard", "lo_segm": "Izā um tämpõ kuonnõ.", "hi_lang": "Estonian",
           "hi_segm": "Isa on täna kodus.", "new_hi_res_lang": "Latvian", "hyp_output": "Tēvs šodien ir mājās.",
           "flt": "ok"}
    df = spark.createDataFrame([rec])
    p = df.select(P.prompt_pivot().alias("p")).first().p
    system, lead, post = P.MESSAGES["Latvian"]
    assert p == (f"<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n{lead}: Estonian.\n\n"
                 f"Isa on täna kodus.\n\n{post}<|im_end|>\n<|im_start|>assistant\n")
    e = synth.accepted_to_entries(df).first()
    assert (e.src_segm, e.src_lang, e.tgt_segm, e.tgt_lang, e.task) == (
        "Tēvs šodien ir mājās.", "Latvian, synth", "Izā um tämpõ kuonnõ.", "Livonian, Standard", "approx-translate")
    t = df.select(L.resource_tier("lo_lang").alias("t"), L.resource_multiplier("lo_lang").alias("m")).first()
    assert (t.t, t.m) == ("xlow", 6)


def test_english_pivot_message_keeps_double_colon(spark):
    df = spark.createDataFrame([("English", "Estonian", "x")], "new_hi_res_lang string, hi_lang string, "
                                                               "hi_segm string")
    assert "this text is: : Estonian." in df.select(P.prompt_pivot().alias("p")).first().p


def test_missing_messages_fail(spark):
    df = spark.createDataFrame([("German", "Estonian", "x")], "new_hi_res_lang string, hi_lang string, "
                                                              "hi_segm string")
    with pytest.raises(Exception):
        df.select(P.prompt_pivot()).collect()


@pytest.mark.parametrize("raw,nllb,madlad,cls", [
    ("en", "eng_Latn", "<2en>", "2+"), ("eng", "eng_Latn", "<2en>", "2+"), ("eng_Latn", "eng_Latn", "<2en>", "2+"),
    ("<2en>", "eng_Latn", "<2en>", "2+"), ("lav", "lvs_Latn", "<2lv>", "?"), ("nor", "nob_Latn", "<2no>", "2+"),
    ("yid", "ydd_Hebr", "<2yi>", "?"), ("liv", "liv_Latn", "<2liv>", "0"), ("udm", "udm_Cyrl", "<2udm>", "1"),
    ("xx", "xx_Unk", "<2xx>", "?")])
def test_language_codes(spark, raw, nllb, madlad, cls):
    df = spark.createDataFrame([(raw,)], "c string")
    r = df.select(CD.to_nllb("c").alias("n"), CD.to_madlad("c").alias("m"), CD.resource_class("c").alias("k")).first()
    assert (r.n, r.m, r.k) == (nllb, madlad, cls)


def test_language_set_aliases(spark):
    df = spark.createDataFrame([("smugri",), ("smugri-low",), ("est,eng",)], "d string")
    got = [r.c for r in df.select(CD.contract_lang_set(CD.expand_lang_set("d")).alias("c")).collect()]
    assert got == ["smugri-full", "smugri-low", "eng,est"]


@pytest.mark.parametrize("n", [0, 1, 15, 16, 17])
def test_batches_have_exactly_b_rows(spark, n):
    B = 16
    df = spark.createDataFrame([(i, i % 5) for i in range(n)], "k long, len int")
    out = BA.length_sorted_batches(df, "k", "len", B)
    sizes = [r["count"] for r in out.groupBy("batch_id").count().collect()]
    assert all(s == B for s in sizes)
    assert sum(sizes) == (0 if n == 0 else -(-n // B) * B)
    originals = out.where(F.col("pad_copy") == 0).select("k").distinct().count()
    assert originals == n


def test_ngram_matches_on_code_points():
    import numpy as np

    from polytext.operators.metrics import _pair_counts, ngram_matches
    assert ngram_matches(np.array([1, 2, 1, 2]), np.array([1, 2, 3]), 4) == [2, 1, 0, 0]
    assert ngram_matches(np.array([], dtype=np.int64), np.array([1]), 2) == [0, 0]
    assert _pair_counts("", "", "a😀b", "😀b")[2:4] == [3, 2]
    assert _pair_counts("", "", "a😀b", "😀b")[8:] == [2, 1, 0, 0, 0, 0]


def test_all_codes_convert(spark):
    from polytext.functions import codes as CD
    rows = [("hin", "hin_Deva", "<2hi>"), ("hi", "hin_Deva", "<2hi>"), ("hin_Deva", "hin_Deva", "<2hi>"), ("vie", "vie_Latn", "<2vi>"),
            ("arb", "arb_Arab", "<2arb>"), ("tha", "tha_Thai", "<2th>"), ("zho", "zho_Hant", "<2zh>"), ("<2et>", "est_Latn", "<2et>"),
            ("lav", "lvs_Latn", "<2lv>"), ("taq", "taq_Tfng", "<2taq>"), ("xxx", "xxx_Unk", "<2xxx>"), ("vro", "vro_Latn", "<2vro>")]
    df = spark.createDataFrame([(r[0],) for r in rows], "c string")
    assert [tuple(r) for r in df.select("c", CD.to_nllb("c"), CD.to_madlad("c")).collect()] == rows
    codes = spark.createDataFrame([(c,) for c in CD.NLLB_CODES], "c string").select("c", CD.to_nllb("c").alias("n")).collect()
    assert len(codes) == 202 and not [r for r in codes if r["n"].endswith("_Unk") or r["n"][:3] != r["c"][:3]]


def test_null_texts_and_languages_are_kept_and_never_ok(spark):
    from polytext.operators import qc, scoring
    df = spark.createDataFrame([(None, "hello", "eng"), ("hello", None, "eng"), ("a", "b", None)], "s string, t string, l string")
    labels = [r[0] for r in df.select(qc.pair_qc_label("s", "t", "l", F.lit("en"))).collect()]
    assert labels[:2] == ["empty", "empty"]
    out = scoring.batched_enrichment(df, "s", "l", "l", ["eng"], scoring.ReverseWordsModel)
    assert out.count() == 3
    n = df.withColumn("n", F.lit(None).cast("int"))
    assert scoring.score_batches(n, "s", n_tokens="n").count() == 3


def test_two_factories_and_repeated_cache_rows(spark):
    from polytext.operators import scoring

    def factory(word):
        return lambda: lambda texts: [word] * len(texts)

    df = spark.createDataFrame([("x",)], "p string")
    assert [scoring.score_batches(df, "p", factory(w)).first()["hyp_output"] for w in ("one", "two")] == ["one", "two"]
    cache = spark.createDataFrame([("x", "b"), ("x", "a")], "p string, hyp_output string")
    assert [r["hyp_output"] for r in scoring.hyp_cache_reuse(df, cache, ["p"], "p").collect()] == ["a"]


def test_any_row_key_counts_tokens(spark):
    from polytext.operators import tokens as TK
    df = spark.createDataFrame([(2**40, "b a"), (-1, "a"), (2**62, "c a")], "k long, t string")
    freq = TK.token_frequency(TK.token_occurrences(df, "k", "t"))
    assert {r["token"]: r["count"] for r in freq.collect()} == {"a": 3, "b": 1, "c": 1}
    assert [r["token"] for r in TK.top_k_tokens(freq, 3).collect()] == ["a", "b", "c"]


def test_vector_lengths_must_match(spark):
    import pytest

    from polytext.operators import scoring
    a = spark.createDataFrame([("x", [1.0, 2.0])], "name string, vec array<double>")
    b = spark.createDataFrame([("x", [1.0])], "name string, vec array<double>")
    with pytest.raises(Exception, match="lengths differ"):
        scoring.vector_table_diff(a, b).collect()
