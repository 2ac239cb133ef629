"""Quality checks of translation pairs (C1, C9) and the script check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polytext.functions.langs import detect_code, sql_detect_code

# QC thresholds.
MAX_LEN_RATIO = 3          # longer/shorter strictly above this -> 'ratio'
LID_MIN_CHARS = 60         # detector disagreement only counts above this length
OVERLENGTH_TOKENS = 1800   # prompts longer than this are not generated
OVERLENGTH_LOGPROB = -100.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pair_qc_label(src, tgt, tgt_lang, detected) -> Column:
    """First match wins.

    empty (either side is NULL or has no characters)
    -> ratio (longer > 3 x shorter, compared in integers)
    -> eq -> ans (exactly one side has '?')
    -> lid-skip (target language has no detector code)
    -> lid-tgt <code> (detector disagrees and target longer than 60 chars)
    -> ok.  ``detected`` is any Column of detector codes ('none' if unknown).
    """
    s, t = _c(src), _c(tgt)
    ls, lt = F.char_length(s), F.char_length(t)
    det = F.coalesce(_c(detected), F.lit("none"))
    expected = detect_code(tgt_lang)
    return (F.when(s.isNull() | t.isNull() | (ls == 0) | (lt == 0), "empty")
            .when(F.greatest(ls, lt) > F.least(ls, lt) * MAX_LEN_RATIO, "ratio")
            .when(s == t, "eq")
            .when(s.contains("?") != t.contains("?"), "ans")
            .when(expected.isNull(), "lid-skip")
            .when((det != expected) & (lt > LID_MIN_CHARS), F.concat(F.lit("lid-tgt "), det))
            .otherwise("ok"))


def sql_pair_qc_label(src: str, tgt: str, tgt_lang: str, detected: str) -> str:
    det = f"coalesce({detected}, 'none')"
    exp = sql_detect_code(tgt_lang)
    return f"""(CASE WHEN {src} IS NULL OR {tgt} IS NULL OR length({src}) = 0 OR length({tgt}) = 0 THEN 'empty'
        WHEN greatest(length({src}), length({tgt})) > least(length({src}), length({tgt})) * {MAX_LEN_RATIO} THEN 'ratio'
        WHEN {src} = {tgt} THEN 'eq'
        WHEN contains({src}, '?') <> contains({tgt}, '?') THEN 'ans'
        WHEN {exp} IS NULL THEN 'lid-skip'
        WHEN {det} <> {exp} AND length({tgt}) > {LID_MIN_CHARS} THEN 'lid-tgt ' || {det}
        ELSE 'ok' END)"""


def pair_qc(df: DataFrame, src: str = "src_segm", tgt: str = "hyp_output", tgt_lang: str = "tgt_lang",
            detected: str | Column = "hyp_lang", out: str = "flt") -> DataFrame:
    """Attach the QC label to every row; all other columns pass through."""
    return df.withColumn(out, pair_qc_label(src, tgt, tgt_lang, detected))


def needs_detection(src, tgt, tgt_lang) -> Column:
    """True where the C1 label depends on the detector: none of the cheap
    checks fired, the target language has a code and the target is longer
    than 60 characters."""
    s, t = _c(src), _c(tgt)
    ls, lt = F.char_length(s), F.char_length(t)
    return ((ls > 0) & (lt > 0) & (F.greatest(ls, lt) <= F.least(ls, lt) * MAX_LEN_RATIO) & (s != t)
            & (s.contains("?") == t.contains("?")) & detect_code(tgt_lang).isNotNull() & (lt > LID_MIN_CHARS))


def pair_qc_with_detector(df: DataFrame, key: str, detect, src: str = "src_segm", tgt: str = "hyp_output",
                          tgt_lang: str = "tgt_lang", out: str = "flt") -> DataFrame:
    """C1 + C2 with the costly step last: the detector (``detect(rows) ->
    (key, detected)``, e.g. ``langid.detect``) runs only on the rows whose
    label depends on it; the others never reach it (same labels)."""
    need = df.where(needs_detection(src, tgt, tgt_lang)).select(key, F.col(tgt).alias("text"))
    det = detect(need)
    j = df.join(det.select(key, "detected"), key, "left")
    return j.withColumn(out, pair_qc_label(src, tgt, tgt_lang, F.col("detected"))).drop("detected")


def pair_qc_counts(df: DataFrame, by=("src_lang", "tgt_lang"), flt: str = "flt") -> DataFrame:
    """Label counts per language pair (partial aggregation, no skew risk)."""
    return df.groupBy(*by, flt).agg(F.count(F.lit(1)).alias("n"))


def overlength_gate(df: DataFrame, n_tokens: str = "n_prompt_tokens", max_len: int = 2000,
                    limit: int = OVERLENGTH_TOKENS) -> DataFrame:
    """Prompts over ``limit`` tokens get output '' and log-prob -100 and are
    not generated; the others get a generation length cap min(max_len, 5*len)."""
    n = F.col(n_tokens)
    over = n > limit
    return df.select("*", over.alias("skip_generation"),
                     F.when(over, F.lit(None)).otherwise(F.least(F.lit(max_len), n * 5)).cast("int")
                     .alias("gen_max_len"),
                     F.when(over, F.lit("")).alias("preset_output"),
                     F.when(over, F.lit(OVERLENGTH_LOGPROB)).alias("preset_logprob"))


# ---------------------------------------------------------------------------
# C6 script check
# ---------------------------------------------------------------------------
# Character classes and the share threshold of the script check.
LATIN_CLASS = "[a-z]"
CYRILLIC_CLASS = "[а-я]"
SCRIPT_SHARE = 0.7
DIALECT_TAG = "^<[^>]+> "


def _count_letters(t: Column, letters: str) -> Column:
    # runs of other characters are deleted: a match for a run, none for a letter
    return F.char_length(F.regexp_replace(t, f"[^{letters[1:-1]}]+", ""))


def text_script(text) -> Column:
    """latn / cyrl / mix / NULL (no letters) of a text after its dialect tag is
    removed; letters ([a-z], [а-я]) are counted on the lower-cased text."""
    t = F.lower(F.regexp_replace(_c(text), DIALECT_TAG, ""))
    lat = _count_letters(t, LATIN_CLASS)
    cyr = _count_letters(t, CYRILLIC_CLASS)
    tot = lat + cyr
    # share > 0.7  <=>  10 * count > 7 * total  (integers, exact)
    return (F.when(tot == 0, F.lit(None).cast("string"))
            .when(lat * 10 > tot * 7, "latn").when(cyr * 10 > tot * 7, "cyrl").otherwise("mix"))


def code_script(code) -> Column:
    """Script part of an NLLB-style code (``eng_Latn`` -> ``latn``); 'unk' when
    there is none."""
    c = _c(code)
    return F.when(F.instr(c, "_") > 0, F.lower(F.substring_index(c, "_", -1))).otherwise("unk")


def is_fishy(text, code) -> Column:
    """A text is fishy when it has letters and its script differs from the
    script of the expected code (an unknown script is always fishy)."""
    ts = text_script(text)
    return F.when(ts.isNull(), F.lit(False)).otherwise(ts != code_script(code))


def sql_text_script(text: str) -> str:
    t = f"lower(regexp_replace({text}, '{DIALECT_TAG}', ''))"
    lat = f"length(regexp_replace({t}, '[^a-z]', '', 'g'))"
    cyr = f"length(regexp_replace({t}, '[^а-я]', '', 'g'))"
    return (f"(CASE WHEN {lat} + {cyr} = 0 THEN NULL WHEN {lat} * 10 > ({lat} + {cyr}) * 7 THEN 'latn' "
            f"WHEN {cyr} * 10 > ({lat} + {cyr}) * 7 THEN 'cyrl' ELSE 'mix' END)")


def sql_code_script(code: str) -> str:
    return f"(CASE WHEN instr({code}, '_') > 0 THEN lower(split_part({code}, '_', -1)) ELSE 'unk' END)"


def sql_is_fishy(text: str, code: str) -> str:
    ts = sql_text_script(text)
    return f"(CASE WHEN {ts} IS NULL THEN false ELSE {ts} <> {sql_code_script(code)} END)"
