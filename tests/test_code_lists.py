"""Coverage of code conversions against the published code lists."""

from __future__ import annotations

from polytext.functions import codes as CD
from polytext.plans import registry


def test_targets_are_the_published_lists(spark, tmp_path):
    assert (len(set(CD.NLLB_CODES)), len(set(CD.MADLAD_CODES))) == (202, 493)
    rows = [(1, "vro"), (2, "sme"), (3, "liv")]  # not among the NLLB codes; <2vro> and <2liv> not among MADLAD's
    spark.createDataFrame([(i, lang, "a text", "s") for i, lang in rows],
                          "doc_id long, lang string, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["direction"]: r for r in registry.queries()["code_conversion_coverage"](spark, str(tmp_path)).collect()}
    codes = {c for i, lang in rows for c in (["est", "rus", "udm", "<2lv>", "xx"][i % 5], lang, f"{lang}_Latn", f"<2{lang}>")}
    for direction, conv, target in (("to_nllb", _nllb, CD.NLLB_CODES), ("to_madlad", _madlad, CD.MADLAD_CODES)):
        good = sum(conv(c) in target for c in codes)
        assert (out[direction]["good"], out[direction]["fail"]) == (good, len(codes) - good)


def _base(code):
    code = code[2:-1] if "<2" in code else code
    return dict(CD.ISO_PAIRS).get(code.split("_")[0], code.split("_")[0])


def _nllb(code):
    return CD.iso3_to_nllb().get(_base(code), _base(code) + "_Unk")


def _madlad(code):
    return f"<2{ {b: a for a, b in CD.ISO_PAIRS}.get(_base(code), _base(code)) }>"


def test_all_four_directions_between_the_lists(spark):
    lists = {"nllb": (CD.NLLB_CODES, _nllb), "madlad": (CD.MADLAD_CODES, _madlad)}
    src = spark.createDataFrame([(s, c) for s, (codes, _) in lists.items() for c in codes], "src string, raw_code string")
    out = {r["direction"]: (r["good"], r["fail"], r["err"]) for r in CD.list_coverage(src).collect()}
    want = {}
    for s, (codes, _) in lists.items():
        for t, (target, conv) in lists.items():
            good = sum(conv(c) in target for c in codes)
            want[f"{s}_to_{t}"] = (good, len(codes) - good, 0)
    assert out == want
