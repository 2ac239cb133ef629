"""The sentence cache (D9, A9, A16), the parallel corpus (A7) and tokenising."""

from __future__ import annotations

import pytest

from polytext.operators import scoring as SC
from polytext.operators import tokens as TK
from polytext.sources import files as FS


def test_equal_sentences_are_scored_once_and_a_rerun_adds_nothing(spark, tmp_path):
    path = f"{tmp_path}/cache"
    req = spark.createDataFrame([(i, "et", "en" if i % 2 else "fi", f"s{i % 3}") for i in range(60)] + [(60, None, "en", "s0"), (61, "et", "en", None)],
                                "doc_id long, src_lang string, tgt_lang string, src_segm string")
    first = {r["doc_id"]: r["hyp_output"] for r in SC.translate_with_cache(req.where("doc_id < 2"), path, "c", "r1").collect()}
    assert FS.read_hyp_cache(spark, path, "c").count() == 2
    for _ in range(2):
        got = {r["doc_id"]: r["hyp_output"] for r in SC.translate_with_cache(req, path, "c", "r2").collect()}
        rows = FS.read_hyp_cache(spark, path, "c")
        assert len(got) == 62 and rows.count() == 8 and rows.where("run = 'r1'").count() == 2
        assert all(got[i] == first[i] for i in first) and got[0] == got[6] and got[61] == ""
    assert FS.read_hyp_cache(spark, path, "other").count() == 0


def test_misses_with_equal_keys_are_scored_once(spark):
    class Counting:
        """Says with how many texts it was called."""

        def __call__(self, texts):
            return [f"{t}|{len(texts)}" for t in texts]

    req = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "y"), (4, None, "z")], "id long, k string, p string")
    cache = spark.createDataFrame([("b", "old"), ("b", "older")], "k string, hyp_output string")
    got = {r["id"]: r["hyp_output"] for r in SC.hyp_cache_reuse(req, cache, ["k"], "p", factory=Counting).collect()}
    assert got == {1: "x|1", 2: "x|1", 3: "old", 4: "z|1"}


def test_sources_are_added_and_replaced_as_a_whole(spark, tmp_path):
    for name, lines in (("a.et", ["1", "2"]), ("a.en", ["one", "two"]), ("b.et", ["3"]), ("b.en", ["three"])):
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    pair = lambda x: (f"{tmp_path}/{x}.et", f"{tmp_path}/{x}.en")
    rows = lambda: sorted((r["source"][-4:-3], r["pos"], r["m"]["et"], r["m"]["en"]) for r in FS.read_parallel_corpus(spark, path).collect())
    path = f"{tmp_path}/corpus"
    FS.append_parallel_sources(spark, path, [pair("a")])
    FS.append_parallel_sources(spark, path, [pair("b"), pair("a")])
    assert rows() == [("a", 0, "1", "one"), ("a", 1, "2", "two"), ("b", 0, "3", "three")]
    (tmp_path / "b.et").write_text("4\n5\n")
    FS.append_parallel_sources(spark, path, [pair("b")])
    assert rows() == [("a", 0, "1", "one"), ("a", 1, "2", "two"), ("b", 0, "4", "three"), ("b", 1, "5", "")]


def test_both_directions_of_two_files_are_zipped_once(spark, tmp_path):
    (tmp_path / "a.et").write_text(" 1\n2\n\n4\n")
    (tmp_path / "a.en").write_text("one\ntwo \n")
    et, en = f"{tmp_path}/a.et", f"{tmp_path}/a.en"
    t = FS.parallel_to_tuples(spark, [(en, et), (et, en), (en, et)])
    assert t._jdf.queryExecution().optimizedPlan().toString().count("Join FullOuter") == 1
    one = [(f"{en}-{et}", 0, {"en": "one", "et": "1"}), (f"{en}-{et}", 1, {"en": "two", "et": "2"})]
    two = [(f"{et}-{en}", i, {"et": x, "en": y}) for i, (x, y) in enumerate([("1", "one"), ("2", "two"), ("", ""), ("4", "")])]
    assert sorted((tuple(r) for r in t.collect()), key=lambda r: r[:2]) == sorted(one * 2 + two, key=lambda r: r[:2])


@pytest.mark.parametrize("limit", [TK.MAX_BROADCAST_BYTES, 0])
def test_tokenise_with_small_and_large_vocabularies(spark, limit):
    rows = [(1, "A b\tc  a"), (1, "b"), (2, None), (3, ""), (None, "zz a"), (4, "a " * 50)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    vocab = spark.createDataFrame([("a", 7), ("b", 8), ("c", 9)], "token string, id int")
    ids = {"a": 7, "b": 8, "c": 9}
    for most, eos in ((None, False), (2, True)):
        got = sorted((str(r["id"]), r["input_ids"], r["attention_mask"]) for r in TK.tokenise(df, "id", "text", vocab, most, eos, limit).collect())
        want = []
        for i, t in rows:
            own = [ids.get(w, TK.UNK_ID) for w in (t or "").lower().split()][:most] + [TK.EOS_ID] * eos
            want.append((str(i), own, [1] * len(own)))
        assert got == sorted(want)
