"""N-way tuples (same sentence in several languages, ``map<string,string>``
with optional ``<lang>-dia`` dialect keys): cleaning (B1, B2), categories
(A5), pair explosion (B3-B6, C7), dialect tags (B7), language streams (C10),
missing high-language plans (D7, D8) and statistics (E8, E9, E11).

Everything is a row-local higher-order function (``map_filter``,
``transform``, ``inline``) -- no shuffle -- except the statistics, which are
partial aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polytext.functions.text import py_strip

# Orthography fix, dialect key suffix and the high-language set
# of the synthetic high-language plan.
LIV_APOSTROPHE = "’"
LIV_KEEP_MARK = "O’R"
DIA_SUFFIX = "-dia"
HIGH_CODES = ["deu", "eng", "est", "fin", "hun", "lvs", "nor", "rus", "swe"]
HIGH_EXCLUDED = ["deu", "swe"]
HIGH_SET = [c for c in HIGH_CODES if c not in HIGH_EXCLUDED]


def fix_orthography(text: Column, lang: Column) -> Column:
    """B2: Livonian text loses the apostrophe unless it contains 'O’R'."""
    return F.when((lang == "liv") & text.contains(LIV_APOSTROPHE) & ~text.contains(LIV_KEEP_MARK),
                  F.replace(text, F.lit(LIV_APOSTROPHE), F.lit(""))).otherwise(text)


def clean_tuple(m: Column, leave_out: list[str] | None = None) -> Column:
    """B1: drop blank values and left-out keys, then apply B2 to the values."""
    lo = leave_out or []
    kept = F.map_filter(m, lambda k, v: (py_strip(v) != "") & (~k.isin(lo) if lo else F.lit(True)))
    return F.transform_values(kept, lambda k, v: fix_orthography(v, k))


def scan_categories(categories: DataFrame, leave_out: list[str] | None = None) -> DataFrame:
    """A5: flatten ``(source, sentences array<map>)`` into cleaned, non-empty
    tuples (one row per tuple, keeping the category and the position)."""
    flat = categories.select("source", F.posexplode("sentences").alias("pos", "m"))
    return flat.select("source", "pos", clean_tuple(F.col("m"), leave_out).alias("m")).where(F.size("m") > 0)


def lang_pairs(m: Column) -> Column:
    """Every ordered pair of distinct keys, no key containing 'dia'."""
    keys = F.filter(F.map_keys(m), lambda k: ~k.contains("dia"))
    return F.flatten(F.transform(keys, lambda a: F.transform(
        F.filter(keys, lambda b: b != a), lambda b: F.struct(a.alias("l1"), b.alias("l2")))))


def full_lang(m: Column, lang: Column) -> Column:
    """B4: 'lang, dialect' when the tuple has a '<lang>-dia' key."""
    return F.concat_ws(", ", lang, F.try_element_at(m, F.concat(lang, F.lit(DIA_SUFFIX))))


def explode_pairs(tuples: DataFrame, m: str = "m", keep: list[str] | None = None,
                  leave_out: list[str] | None = None, leave_only: list[str] | None = None,
                  tag_dialect: bool = True) -> DataFrame:
    """B3 + C7 + B6: one row per ordered language pair of every tuple, with
    the deny list ``leave_out`` and allow list ``leave_only`` of 'l1-l2'
    keys; the input gets a '<dialect> ' tag when the target has a dialect key."""
    keep = keep or []
    p = tuples.select(*keep, F.col(m).alias("_m"), F.inline(lang_pairs(F.col(m))))
    lp = F.concat_ws("-", "l1", "l2")
    if leave_out:
        p = p.where(~lp.isin(leave_out))
    if leave_only is not None:
        p = p.where(lp.isin(leave_only))
    src = F.element_at("_m", F.col("l1"))
    dia = F.try_element_at(F.col("_m"), F.concat(F.col("l2"), F.lit(DIA_SUFFIX)))
    inp = F.when(dia.isNotNull() & F.lit(tag_dialect), F.concat(F.lit("<"), dia, F.lit("> "), src)).otherwise(src)
    return p.select(*keep, F.col("l1").alias("src_lang"), F.col("l2").alias("tgt_lang"), inp.alias("input"),
                    F.element_at("_m", F.col("l2")).alias("output"))


def tuples_to_entries(tuples: DataFrame, m: str = "m", keep: list[str] | None = None) -> DataFrame:
    """Translation entries with full language labels."""
    keep = keep or []
    p = tuples.select(*keep, F.col(m).alias("_m"), F.inline(lang_pairs(F.col(m))))
    return p.select(*keep, F.lit("translate").alias("task"),
                    F.element_at("_m", F.col("l1")).alias("src_segm"),
                    F.element_at("_m", F.col("l2")).alias("tgt_segm"),
                    full_lang(F.col("_m"), F.col("l1")).alias("src_lang"),
                    full_lang(F.col("_m"), F.col("l2")).alias("tgt_lang"))


DIALECT_TAG = "^<[^>]+> "


def untag_dialect(text: Column) -> Column:
    """Drop a leading '<...> ' tag."""
    return F.when(text.contains(">"), F.regexp_replace(text, DIALECT_TAG, "")).otherwise(text)


def texts_in_langs(tuples: DataFrame, langs: list[str], m: str = "m") -> DataFrame:
    """The texts of the wanted languages (tokeniser training stream)."""
    return tuples.select(F.explode(m).alias("lang", "text")).where(F.col("lang").isin(langs))


def present_high(m: Column) -> Column:
    return F.array_sort(F.filter(F.map_keys(m), lambda k: ~k.contains(DIA_SUFFIX) & k.isin(HIGH_SET)))


def missing_high_langs(tuples: DataFrame, m: str = "m", keep: list[str] | None = None) -> DataFrame:
    """Per tuple every (present high language, absent high language)."""
    keep = keep or []
    pres = present_high(F.col(m))
    missing = F.array_except(F.array(*[F.lit(x) for x in HIGH_SET]), pres)
    pairs = F.flatten(F.transform(missing, lambda t: F.transform(pres, lambda s: F.struct(
        s.alias("src"), t.alias("tgt")))))
    return tuples.select(*keep, F.col(m).alias("_m"), F.inline(pairs)).select(
        *keep, "src", "tgt", F.element_at("_m", F.col("src")).alias("sentence"))


def lang_signature_stats(tuples: DataFrame, m: str = "m") -> DataFrame:
    """Tuples per sorted, '-'-joined set of non-blank keys."""
    keys = F.array_sort(F.map_keys(F.map_filter(m, lambda k, v: py_strip(v) != "")))
    return tuples.groupBy(F.array_join(keys, "-").alias("signature")).agg(F.count(F.lit(1)).alias("n"))


def synth_plan_stats(tuples: DataFrame, source: str = "source", pos: str = "pos", m: str = "m") -> DataFrame:
    """Per category: sentences, present high languages of the category's
    *first* sentence, sentences x present, sentences x present x missing (the
    reference extrapolates from the first sentence, Q16), plus the exact sums
    over every sentence; and a grand-total row (source NULL)."""
    hs = F.size(F.filter(F.map_keys(m), lambda k: ~k.contains("dia") & k.isin(HIGH_SET)))
    first = tuples.select(source, pos, hs.alias("_hs")).groupBy(source).agg(
        F.count(F.lit(1)).alias("n_sentences"),
        F.min_by("_hs", F.col(pos)).alias("n_high"),
        F.sum("_hs").cast("bigint").alias("exact_sent_x_high"),
        F.sum(F.col("_hs") * (len(HIGH_SET) - F.col("_hs"))).cast("bigint").alias("exact_to_translate"))
    per = first.select(source, "n_sentences", "n_high",
                       (F.col("n_sentences") * F.col("n_high")).alias("n_sent_x_high"),
                       (F.col("n_sentences") * F.col("n_high") * (len(HIGH_SET) - F.col("n_high")))
                       .alias("n_to_translate"), "exact_sent_x_high", "exact_to_translate")
    tot = per.agg(F.lit(None).cast("string").alias(source), F.sum("n_sentences").alias("n_sentences"),
                  F.lit(None).cast("int").alias("n_high"), F.sum("n_sent_x_high").alias("n_sent_x_high"),
                  F.sum("n_to_translate").alias("n_to_translate"),
                  F.sum("exact_sent_x_high").cast("bigint").alias("exact_sent_x_high"),
                  F.sum("exact_to_translate").cast("bigint").alias("exact_to_translate"))
    return per.unionByName(tot)


def lang_char_share(pairs: DataFrame) -> DataFrame:
    """Characters per language as a share of all characters, over both
    sides of every pair, and the mean segment length (second output column
    repeated on every row)."""
    sides = pairs.select(F.inline(F.array(
        F.struct(F.col("src_lang").alias("lang"), F.char_length("input").alias("n")),
        F.struct(F.col("tgt_lang").alias("lang"), F.char_length("output").alias("n")))))
    per = sides.groupBy("lang").agg(F.sum("n").alias("chars"), F.count(F.lit(1)).alias("segments"))
    # one row per language (a bounded table), so a global window is cheap here
    w = Window.partitionBy()
    return per.select("lang", "chars", (F.col("chars") / F.sum("chars").over(w)).alias("share"),
                      (F.sum("chars").over(w) / F.sum("segments").over(w)).alias("avg_length"))


def training_pairs(tuples: DataFrame, m: str = "m", keep: list[str] | None = None,
                   leave_out: list[str] | None = None, leave_only: list[str] | None = None,
                   exclude: DataFrame | None = None, model_type: str | None = None) -> DataFrame:
    """The reference's pair extraction for training: B3 pairs (+C7 lists, B6
    dialect tags), pairs whose source or target text is in the per-language
    exclusion set dropped (D1), language codes converted to the model's style
    (D5: 'nllb', 'madlad' or None for unchanged), and pairs whose input or
    output is in the wrong script dropped (C6, judged on the NLLB script)."""
    from polytext.functions import codes as CD
    from polytext.operators.qc import is_fishy

    keep = keep or []
    p = explode_pairs(tuples, m=m, keep=keep, leave_out=leave_out, leave_only=leave_only)
    if exclude is not None:
        from polytext.operators.contamination import decontaminate
        # the exclusion is checked on the untagged source text
        p = p.withColumn("_src_raw", untag_dialect(F.col("input")))
        p = decontaminate(p, exclude, src="_src_raw", tgt="output").drop("_src_raw")
    ok = ~is_fishy(F.col("input"), CD.to_nllb("src_lang")) & ~is_fishy(F.col("output"), CD.to_nllb("tgt_lang"))
    conv = {"nllb": CD.to_nllb, "madlad": CD.to_madlad}.get(model_type)
    p = p.where(ok)
    if conv is not None:
        p = p.withColumn("src_lang", conv("src_lang")).withColumn("tgt_lang", conv("tgt_lang"))
    return p
