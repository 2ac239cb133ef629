"""Registered queries: n-way tuples."""

from __future__ import annotations

from pyspark.sql import functions as F

from polytext.operators import tuples as TU
from polytext.plans import views as V
from polytext.plans.registry import register

_HIGH = "(" + ", ".join(f"'{x}'" for x in TU.HIGH_SET) + ")"

# cleaned long form (B1 + B2)
_CLEAN = """clean AS (SELECT tuple_id, key,
  CASE WHEN key = 'liv' AND contains(value, '’') AND NOT contains(value, 'O’R') THEN replace(value, '’', '')
       ELSE value END AS value
  FROM v_tuple_items WHERE trim(value) <> '')"""


def _long(df, m="m", keep=("tuple_id",)):
    return df.select(*keep, F.explode(m).alias("key", "value"))


register("clean_tuples", V.with_views("SELECT * FROM clean", "v_tuple_items", ctes=_CLEAN))(
    lambda spark, sf: _long(V.tuples(spark, sf).select("tuple_id", TU.clean_tuple(F.col("m")).alias("m"))))


def _categories(spark, sf):
    # category rows as the JSON corpus format has them: (source, sentences);
    # a category holds at most 100 tuples by construction of the fixture
    t = V.tuples(spark, sf)
    by_pos = lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0)
    return t.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("pos", "m")), by_pos).alias("_s")) \
        .select("source", F.transform("_s", lambda x: x["m"]).alias("sentences"),
                F.transform("_s", lambda x: x["pos"]).alias("_pos"))


def _category_files(spark, sf):
    from polytext.plans.catalog_io import _tmp
    from polytext.sources import files as FS
    from polytext.sources.json_arrays import write_json_arrays
    path = _tmp(spark, "categories")
    write_json_arrays(_categories(spark, sf).drop("_pos"), path)
    return FS.read_categories(spark, path)


register("scan_categories", V.with_views(
    "SELECT 'cat' || CAST(tuple_id // 100 AS VARCHAR) AS source, tuple_id % 100 AS pos, key, value FROM clean",
    "v_tuple_items", ctes=_CLEAN))(
    lambda spark, sf: TU.scan_categories(_category_files(spark, sf))
    .select("source", F.col("pos").cast("bigint").alias("pos"), F.explode("m").alias("key", "value")))

_PAIRS = _CLEAN + """,
pairs AS (SELECT a.tuple_id, a.key AS src_lang, b.key AS tgt_lang,
    CASE WHEN d.value IS NOT NULL THEN '<' || d.value || '> ' || a.value ELSE a.value END AS input,
    b.value AS output, da.value AS src_dia, d.value AS tgt_dia, a.value AS src_segm
  FROM clean a JOIN clean b ON a.tuple_id = b.tuple_id AND a.key <> b.key
  LEFT JOIN clean d ON d.tuple_id = b.tuple_id AND d.key = b.key || '-dia'
  LEFT JOIN clean da ON da.tuple_id = a.tuple_id AND da.key = a.key || '-dia'
  WHERE NOT contains(a.key, 'dia') AND NOT contains(b.key, 'dia'))"""


def _clean_tuples(spark, sf):
    return V.tuples(spark, sf).select("tuple_id", TU.clean_tuple(F.col("m")).alias("m"))


register("explode_pairs", V.with_views("SELECT tuple_id, src_lang, tgt_lang, input, output FROM pairs",
                                       "v_tuple_items", ctes=_PAIRS))(
    lambda spark, sf: TU.explode_pairs(_clean_tuples(spark, sf), keep=["tuple_id"]))

register("lp_allow_deny", V.with_views(
    "SELECT tuple_id, src_lang, tgt_lang, input, output FROM pairs WHERE src_lang || '-' || tgt_lang <> 'est-rus' "
    "AND src_lang || '-' || tgt_lang IN ('est-rus', 'rus-est', 'liv-est', 'est-liv')", "v_tuple_items", ctes=_PAIRS))(
    lambda spark, sf: TU.explode_pairs(_clean_tuples(spark, sf), keep=["tuple_id"], leave_out=["est-rus"],
                                       leave_only=["est-rus", "rus-est", "liv-est", "est-liv"]))

register("tuples_to_entries", V.with_views(
    "SELECT tuple_id, 'translate' AS task, src_segm, output AS tgt_segm, "
    "src_lang || coalesce(', ' || src_dia, '') AS src_lang, tgt_lang || coalesce(', ' || tgt_dia, '') AS tgt_lang "
    "FROM pairs", "v_tuple_items", ctes=_PAIRS))(
    lambda spark, sf: TU.tuples_to_entries(_clean_tuples(spark, sf), keep=["tuple_id"]))

register("untag_dialect", V.with_views(
    "SELECT tuple_id, src_lang, tgt_lang, CASE WHEN contains(input, '>') THEN regexp_replace(input, '^<[^>]+> ', '') "
    "ELSE input END AS untagged FROM pairs", "v_tuple_items", ctes=_PAIRS))(
    lambda spark, sf: TU.explode_pairs(_clean_tuples(spark, sf), keep=["tuple_id"])
    .select("tuple_id", "src_lang", "tgt_lang", TU.untag_dialect(F.col("input")).alias("untagged")))

register("texts_in_langs", V.with_views("SELECT key AS lang, value AS text FROM clean WHERE key IN ('est', 'liv')",
                                        "v_tuple_items", ctes=_CLEAN))(
    lambda spark, sf: TU.texts_in_langs(_clean_tuples(spark, sf), ["est", "liv"]))

register("missing_high_langs", V.with_views(f"""
SELECT p.tuple_id, p.key AS src, h.code AS tgt, p.value AS sentence
FROM v_tuple_items p JOIN (SELECT unnest({list(TU.HIGH_SET)}) AS code) h ON true
WHERE p.key IN {_HIGH} AND NOT contains(p.key, '-dia')
  AND NOT EXISTS (SELECT 1 FROM v_tuple_items q WHERE q.tuple_id = p.tuple_id AND q.key = h.code)""",
                                            "v_tuple_items"))(
    lambda spark, sf: TU.missing_high_langs(V.tuples(spark, sf), keep=["tuple_id"]))

register("lang_signature_stats", V.with_views(
    "SELECT signature, count(*) AS n FROM (SELECT tuple_id, string_agg(key, '-' ORDER BY key) AS signature "
    "FROM clean GROUP BY tuple_id) GROUP BY signature", "v_tuple_items", ctes=_CLEAN))(
    lambda spark, sf: TU.lang_signature_stats(V.tuples(spark, sf)))

register("synth_plan_stats", V.with_views(f"""
SELECT source, n_sentences, n_high, n_sentences * n_high AS n_sent_x_high,
  n_sentences * n_high * ({len(TU.HIGH_SET)} - n_high) AS n_to_translate, exact_sent_x_high, exact_to_translate FROM per
UNION ALL
SELECT NULL, CAST(sum(n_sentences) AS BIGINT), NULL, CAST(sum(n_sentences * n_high) AS BIGINT),
  CAST(sum(n_sentences * n_high * ({len(TU.HIGH_SET)} - n_high)) AS BIGINT),
  CAST(sum(exact_sent_x_high) AS BIGINT), CAST(sum(exact_to_translate) AS BIGINT)
FROM per""", "v_tuple_items", ctes=f"""
per_tuple AS (SELECT tuple_id, count(*) FILTER (WHERE key IN {_HIGH} AND NOT contains(key, 'dia')) AS nh
  FROM v_tuple_items GROUP BY tuple_id),
per AS (SELECT 'cat' || CAST(tuple_id // 100 AS VARCHAR) AS source, count(*) AS n_sentences,
  CAST(arg_min(nh, tuple_id) AS INTEGER) AS n_high, CAST(sum(nh) AS BIGINT) AS exact_sent_x_high,
  CAST(sum(nh * ({len(TU.HIGH_SET)} - nh)) AS BIGINT) AS exact_to_translate FROM per_tuple GROUP BY 1)"""))(
    lambda spark, sf: TU.synth_plan_stats(V.tuples(spark, sf)))

register("lang_char_share", V.with_views("""
SELECT lang, chars, chars / sum(chars) OVER () AS share, sum(chars) OVER () / sum(segments) OVER () AS avg_length
FROM (SELECT lang, CAST(sum(n) AS BIGINT) AS chars, count(*) AS segments FROM (
  SELECT src_lang AS lang, length(input) AS n FROM pairs UNION ALL SELECT tgt_lang, length(output) FROM pairs)
  GROUP BY lang)""", "v_tuple_items", ctes=_PAIRS))(
    lambda spark, sf: TU.lang_char_share(TU.explode_pairs(_clean_tuples(spark, sf), keep=["tuple_id"])))


# get-pairs path: pairs -> exclusion -> model codes -> script filter (C6 on both sides)
def _excluded(spark, sf):
    """The dev texts of every tuple language: the benchmark's items, whole and by
    sentence (the benchmark has no language, so it is a parallel dev set)."""
    texts = V.table(spark, sf, "benchmark").select(F.col("text").alias("sentence"))
    dev = texts.unionByName(V.dev_sentences(spark, sf).select("sentence")).distinct()
    return dev.select("sentence", F.explode(F.array(*[F.lit(x) for x in V.TUPLE_KEYS])).alias("lang"))


def _training_pairs(spark, sf):
    return TU.training_pairs(_clean_tuples(spark, sf), keep=["tuple_id"], model_type="nllb",
                             exclude=_excluded(spark, sf))


def _sql_training_pairs() -> str:
    from polytext.functions import codes as CD
    from polytext.operators import qc as Q

    def script(lat, cyr):
        return (f"(CASE WHEN {lat} * 10 > ({lat} + {cyr}) * 7 THEN 'latn' "
                f"WHEN {cyr} * 10 > ({lat} + {cyr}) * 7 THEN 'cyrl' ELSE 'mix' END)")

    def fishy(lat, cyr, code):
        return f"(CASE WHEN {lat} + {cyr} = 0 THEN false ELSE {script(lat, cyr)} <> {Q.sql_code_script(code)} END)"

    return f"""
SELECT tuple_id, sl AS src_lang, tl AS tgt_lang, input, output FROM (
  SELECT tuple_id, input, output, sl, tl,
    length(regexp_replace(ti, '[^a-z]', '', 'g')) AS il, length(regexp_replace(ti, '[^а-я]', '', 'g')) AS ic,
    length(regexp_replace(tt, '[^a-z]', '', 'g')) AS ol, length(regexp_replace(tt, '[^а-я]', '', 'g')) AS oc
  FROM (SELECT tuple_id, input, output, {CD.sql_to_nllb('src_lang')} AS sl, {CD.sql_to_nllb('tgt_lang')} AS tl,
          lower(regexp_replace(input, '{Q.DIALECT_TAG}', '')) AS ti,
          lower(regexp_replace(output, '{Q.DIALECT_TAG}', '')) AS tt
        FROM pairs WHERE regexp_replace(input, '{Q.DIALECT_TAG}', '') NOT IN (SELECT sentence FROM dev)
          AND output NOT IN (SELECT sentence FROM dev)))
WHERE NOT {fishy('il', 'ic', 'sl')} AND NOT {fishy('ol', 'oc', 'tl')}"""


register("training_pairs", V.with_views(_sql_training_pairs(), "v_tuple_items", "v_dev", ctes=_PAIRS + """,
dev AS (SELECT text AS sentence FROM benchmark WHERE text IS NOT NULL UNION SELECT sentence FROM v_dev)"""))(_training_pairs)
