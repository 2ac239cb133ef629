"""Registered queries: corpus metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from polytext.functions import langs as L
from polytext.functions import text as T
from polytext.operators import metrics as M
from polytext.plans import views as V
from polytext.plans.registry import register

B, C = M.BLEU_ORDER, M.CHRF_ORDER


# ---------------------------------------------------------------------------
# DuckDB text of the metric plan
# ---------------------------------------------------------------------------

def _sql_bleu() -> str:
    zeros = "0"
    logs = []
    for n in range(1, B + 1):
        tot, cor = f"bleu_total_{n}", f"bleu_correct_{n}"
        zeros = f"({zeros} + CASE WHEN {tot} > 0 AND {cor} = 0 THEN 1 ELSE 0 END)"
        p = (f"(CASE WHEN {tot} = 0 THEN 0.0 WHEN {cor} = 0 THEN 100.0 / (pow(2.0, {zeros}) * {tot}) "
             f"ELSE 100.0 * {cor} / {tot} END)")
        logs.append(f"(CASE WHEN {p} = 0 THEN {M.BLEU_LOG_ZERO} ELSE ln({p}) END)")
    s = " + ".join(logs)
    bp = ("(CASE WHEN sys_len < ref_len THEN (CASE WHEN sys_len > 0 THEN exp(1 - ref_len / sys_len) ELSE 0.0 END) "
          "ELSE 1.0 END)")
    anyc = " + ".join(f"bleu_correct_{n}" for n in range(1, B + 1))
    return f"(CASE WHEN {anyc} > 0 THEN {bp} * exp(({s}) / {B}) ELSE 0.0 END)"


def _sql_chrf() -> str:
    precs, recs, effs = [], [], []
    for n in range(1, C + 1):
        h, r, m = f"chrf_hyp_{n}", f"chrf_ref_{n}", f"chrf_match_{n}"
        both = f"({h} > 0 AND {r} > 0)"
        precs.append(f"(CASE WHEN {both} THEN {m} / {h} ELSE 0.0 END)")
        recs.append(f"(CASE WHEN {both} THEN {m} / {r} ELSE 0.0 END)")
        effs.append(f"(CASE WHEN {both} THEN 1 ELSE 0 END)")
    sp, sr, se = " + ".join(precs), " + ".join(recs), " + ".join(effs)
    ap = f"(CASE WHEN ({se}) = 0 THEN 0.0 ELSE ({sp}) / ({se}) END)"
    ar = f"(CASE WHEN ({se}) = 0 THEN 0.0 ELSE ({sr}) / ({se}) END)"
    f2 = M.CHRF_BETA * M.CHRF_BETA
    return f"(CASE WHEN {ap} + {ar} > 0 THEN 100.0 * ((1 + {f2}) * {ap} * {ar}) / ({f2} * {ap} + {ar}) ELSE 0.0 END)"


def sql_row_stats(source: str, rid: str, hyp: str, ref: str, keep: list[str]) -> str:
    """CTE text producing per-row statistics named ``stats``."""
    kp = "".join(f"{k}, " for k in keep)
    wvals = ", ".join(f"({n})" for n in range(1, B + 1))
    cvals = ", ".join(f"({n})" for n in range(1, C + 1))
    tot = ", ".join(f"greatest(sys_len - {n - 1}, 0) AS bleu_total_{n}" for n in range(1, B + 1))
    hyp_n = ", ".join(f"greatest(lch - {n - 1}, 0) AS chrf_hyp_{n}" for n in range(1, C + 1))
    ref_n = ", ".join(f"greatest(lcr - {n - 1}, 0) AS chrf_ref_{n}" for n in range(1, C + 1))
    cor = ", ".join(f"CAST(coalesce(sum(m) FILTER (WHERE kn = {n}), 0) AS BIGINT) AS bleu_correct_{n}"
                    for n in range(1, B + 1))
    mat = ", ".join(f"CAST(coalesce(sum(m) FILTER (WHERE kn = {10 + n}), 0) AS BIGINT) AS chrf_match_{n}"
                    for n in range(1, C + 1))
    fill = ", ".join([f"coalesce(bleu_correct_{n}, 0) AS bleu_correct_{n}" for n in range(1, B + 1)]
                     + [f"coalesce(chrf_match_{n}, 0) AS chrf_match_{n}" for n in range(1, C + 1)])

    def wg(col, side):
        return (f"SELECT rid, n AS kn, array_to_string({col}[i:i + n - 1], ' ') AS g, {side} AS s FROM "
                f"(SELECT rid, {col}, n, unnest(range(1, len({col}) - n + 2)) AS i FROM toks, (VALUES {wvals}) v(n) "
                f"WHERE len({col}) >= n)")

    def cg(col, side):
        return (f"SELECT rid, 10 + n AS kn, substr({col}, i, n) AS g, {side} AS s FROM "
                f"(SELECT rid, {col}, n, unnest(range(1, length({col}) - n + 2)) AS i FROM toks, "
                f"(VALUES {cvals}) v(n) WHERE length({col}) >= n)")

    return f"""
toks AS (SELECT {rid} AS rid, {kp}{T.sql_split_tokens(T.sql_tok13a(hyp))} AS th,
         {T.sql_split_tokens(T.sql_tok13a(ref))} AS tr,
         {T.sql_remove_ws(hyp)} AS ch, {T.sql_remove_ws(ref)} AS cr FROM {source}),
lens AS (SELECT rid, {kp}CAST(len(th) AS BIGINT) AS sys_len, CAST(len(tr) AS BIGINT) AS ref_len,
         CAST(length(ch) AS BIGINT) AS lch, CAST(length(cr) AS BIGINT) AS lcr FROM toks),
grams AS ({wg('th', 0)} UNION ALL {wg('tr', 1)} UNION ALL {cg('ch', 0)} UNION ALL {cg('cr', 1)}),
pg AS (SELECT rid, kn, least(sum(1 - s), sum(s)) AS m FROM grams GROUP BY rid, kn, g),
po AS (SELECT rid, {cor}, {mat} FROM pg GROUP BY rid),
stats AS (SELECT rid AS {rid}, {kp}sys_len, ref_len, {tot}, {fill}, {hyp_n}, {ref_n}
          FROM lens LEFT JOIN po USING (rid))"""


def _sql_sum_cols() -> str:
    return ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in M.STAT_COLS)


def _sql_groups(s: str, t: str) -> str:
    gen = f"{L.sql_gen_lang_metric(s)} || ' -> ' || {L.sql_gen_lang_metric(t)}"
    det = f"{s} || ' -> ' || {t}"
    cls = f"{L.sql_resource_tier(s)} || ' -> ' || {L.sql_resource_tier(t)}"
    return (f"list_filter(['general: ' || {gen}, CASE WHEN ({det}) <> ({gen}) THEN 'detailed: ' || {det} END, "
            f"'classes: ' || {cls}], lambda x: x IS NOT NULL)")


_METRIC_SRC = "(SELECT hyp_index, src_lang, tgt_lang, tgt_segm, hyp_output FROM v_hyps WHERE tgt_segm IS NOT NULL)"

_STATS2 = sql_row_stats(_METRIC_SRC, 'hyp_index', 'hyp_output', 'tgt_segm', ['src_lang', 'tgt_lang'])

CORPUS_METRICS_SQL = V.with_views(f"""
SELECT lp, n_rows, round({_sql_bleu()}, 2) AS bleu, round({_sql_chrf()}, 2) AS chrf FROM sums""", "v_hyps",
                                  ctes=_STATS2 + f""",
grouped AS (SELECT unnest({_sql_groups('src_lang', 'tgt_lang')}) AS lp, * FROM stats),
sums AS (SELECT lp, count(*) AS n_rows, {_sql_sum_cols()} FROM grouped GROUP BY lp)""")


@register("corpus_metrics", CORPUS_METRICS_SQL)
def corpus_metrics(spark, sf):
    h = V.hyps(spark, sf)
    return M.corpus_metrics(h.select("hyp_index", "src_lang", "tgt_lang", "tgt_segm"),
                            h.select("hyp_index", "hyp_output"))


# ---- E4 macro average of pair scores per resource-class pair (A15 long table)
MACRO_SQL = V.with_views(f"""
SELECT lp || '-bleu' AS key, round(bleu, 2) AS score FROM per_lp
UNION ALL SELECT lp || '-chrf', round(chrf, 2) FROM per_lp
UNION ALL SELECT cls || '-bleu', round(avg(bleu), 2) FROM per_lp GROUP BY cls
UNION ALL SELECT cls || '-chrf', round(avg(chrf), 2) FROM per_lp GROUP BY cls""", "v_hyps", ctes=_STATS2 + f""",
keyed AS (SELECT src_lang || '-' || tgt_lang AS lp,
          {L.sql_resource_tier('src_lang')} || '-' || {L.sql_resource_tier('tgt_lang')} AS cls, * FROM stats),
sums AS (SELECT lp, cls, count(*) AS n_rows, {_sql_sum_cols()} FROM keyed GROUP BY lp, cls),
per_lp AS (SELECT lp, cls, {_sql_bleu()} AS bleu, {_sql_chrf()} AS chrf FROM sums)""")


@register("macro_average_by_class", MACRO_SQL)
def macro_average(spark, sf):
    h = V.hyps(spark, sf).where(F.col("tgt_segm").isNotNull())
    stats = M.row_statistics(h, "hyp_index", "hyp_output", "tgt_segm", keep=["src_lang", "tgt_lang"])
    keyed = stats.select(F.concat_ws("-", "src_lang", "tgt_lang").alias("lp"),
                         F.concat_ws("-", L.resource_tier("src_lang"), L.resource_tier("tgt_lang")).alias("cls"),
                         *M.STAT_COLS)
    return M.macro_average_by_class(keyed, "lp", "cls")


# ---- E3 group membership counts (ragged grouping sets), exact integers
register("metric_groups", V.with_views(f"""
SELECT lp, count(*) AS n_rows FROM (
  SELECT unnest({_sql_groups('src_lang', 'tgt_lang')}) AS lp FROM v_entries WHERE tgt_segm IS NOT NULL)
GROUP BY lp""", "v_entries"))(
    lambda spark, sf: V.entries(spark, sf).where(F.col("tgt_segm").isNotNull())
    .select(F.explode(M.metric_groups("src_lang", "tgt_lang")).alias("lp")).groupBy("lp")
    .agg(F.count(F.lit(1)).alias("n_rows")))

# ---- per-row statistics (exact integers): BLEU / chrF sufficient statistics
register("metric_row_stats", V.with_views("SELECT * FROM stats", "v_hyps",
                                          ctes=sql_row_stats(_METRIC_SRC, 'hyp_index', 'hyp_output', 'tgt_segm', [])))(
    lambda spark, sf: M.row_statistics(V.hyps(spark, sf).where(F.col("tgt_segm").isNotNull()),
                                       "hyp_index", "hyp_output", "tgt_segm"))


# ---- D3 + F3: outputs re-paired with inputs on the index, in index order
register("zip_inputs_outputs", V.with_views("""
SELECT e.doc_id AS hyp_index, e.src_segm, e.tgt_segm, h.hyp_output
FROM v_entries e JOIN v_hyps h ON h.hyp_index = e.doc_id""", "v_hyps"))(
    lambda spark, sf: V.entries(spark, sf).select(F.col("doc_id").alias("hyp_index"), "src_segm", "tgt_segm")
    .join(V.hyps(spark, sf).select("hyp_index", "hyp_output"), "hyp_index", "inner"))

register("order_by_index", V.with_views("SELECT hyp_index, hyp_output FROM v_hyps ORDER BY hyp_index", "v_hyps"))(
    lambda spark, sf: M.order_by_index(V.hyps(spark, sf)))
