"""Language tables and the Column builders that use them.

The tables are tiny and fixed, so they are rendered as literal expressions
(``CASE``/``IN``/``map`` literals) that stay inside whole-stage codegen; no
join and no broadcast is needed for them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the reference's tables for right results.
# ---------------------------------------------------------------------------
# Resource tiers by generic language name.
TIER_HIGH = ["Estonian", "English", "Russian", "Finnish", "Hungarian", "Latvian", "German", "Swedish",
             "Norwegian", "French"]
TIER_MID = ["Komi", "Komi-Zyrian", "Northern Sami", "Meadow Mari"]
TIER_LOW = ["Udmurt", "Proper Karelian", "Southern Sami", "Livvi", "Veps", "Moksha", "Erzya", "Lule Sami", "Võro",
            "Hill Mari", "Komi-Permyak", "Inari Sami"]
TIER_XLOW = ["Ludian", "Livonian", "Izhorian", "Votic", "Shur Khanty", "Skolt Sami", "Meänkieli", "Sred Khanty",
             "Surgut Khanty", "Priur Khanty", "Vakh Khanty", "Unk Khanty", "Pite Sami", "Mansi", "Kazym Khanty",
             "Kven", "Ume Sami", "Kildin Sami"]
# High-resource output languages and their sampling weights, in this order.
HI_RES_WEIGHTS = [("English", 13), ("Estonian", 11), ("Finnish", 8), ("Hungarian", 3), ("Latvian", 2),
                  ("Russian", 4), ("Swedish", 2), ("Norwegian", 2), ("German", 0), ("French", 0)]
# Codes that also count as high-resource.
HI_RES_CODES = ["est", "eng", "fin", "hun", "lvs", "nor", "rus"]
# Language name -> two-letter code expected from the language detector.
DETECT_CODES = [("English", "en"), ("Estonian", "et"), ("Finnish", "fi"), ("Hungarian", "hu"), ("Latvian", "lv"),
                ("Russian", "ru"), ("Swedish", "sv"), ("Norwegian", "no"), ("German", "de"), ("French", "fr")]
# Suffixes dropped from Estonian labels by the synthetic-data generic-language rule.
ESTONIAN_DROP_SUFFIXES = [", dictionary", ", speech", ", ocr"]
# Resource multipliers by tier for the synthetic-data plans.
MULT_XLOW, MULT_LOW, MULT_OTHER = 6, 4, 2
# ---------------------------------------------------------------------------

HI_RES_NAMES = [n for n, _ in HI_RES_WEIGHTS]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def gen_lang_metric(lang) -> Column:
    """Language without variety = text before the first comma."""
    return F.substring_index(_c(lang), ",", 1)


def gen_lang_synth(lang) -> Column:
    """As B17, except labels starting with ``Estonian`` only lose the
    dictionary/speech/ocr suffixes and keep any other variety."""
    c = _c(lang)
    est = c
    for s in ESTONIAN_DROP_SUFFIXES:
        est = F.replace(est, F.lit(s), F.lit(""))
    return F.when(c.startswith("Estonian"), est).otherwise(F.substring_index(c, ",", 1))


def is_high_resource(lang) -> Column:
    """Name in the weights table or in the high-resource code set."""
    c = _c(lang)
    return c.isin(HI_RES_NAMES) | c.isin(HI_RES_CODES)


def resource_tier(lang) -> Column:
    """high/mid/low/xlow of the generic (B17) language, '?' when unknown."""
    g = gen_lang_metric(lang)
    return (F.when(g.isin(TIER_HIGH), "high").when(g.isin(TIER_MID), "mid")
            .when(g.isin(TIER_LOW), "low").when(g.isin(TIER_XLOW), "xlow").otherwise("?"))


def resource_multiplier(lang) -> Column:
    """H3: 6 for extra-low, 4 for low, 2 otherwise (uses the B18 rule)."""
    g = gen_lang_synth(lang)
    return (F.when(g.isin(TIER_XLOW), MULT_XLOW).when(g.isin(TIER_LOW), MULT_LOW)
            .otherwise(MULT_OTHER)).cast("int")


def detect_code(lang) -> Column:
    """Expected detector code of a language name; NULL when not in the table."""
    m = F.create_map(*[F.lit(x) for kv in DETECT_CODES for x in kv])
    return F.try_element_at(m, _c(lang))


# ---- DuckDB text of the same builders (oracle SQL) ----

def _sql_list(xs) -> str:
    return "(" + ", ".join(sql_str(x) for x in xs) + ")"


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_gen_lang_metric(e: str) -> str:
    return f"split_part({e}, ',', 1)"


def sql_gen_lang_synth(e: str) -> str:
    est = e
    for s in ESTONIAN_DROP_SUFFIXES:
        est = f"replace({est}, {sql_str(s)}, '')"
    return f"(CASE WHEN starts_with({e}, 'Estonian') THEN {est} ELSE split_part({e}, ',', 1) END)"


def sql_is_high_resource(e: str) -> str:
    return f"({e} IN {_sql_list(HI_RES_NAMES)} OR {e} IN {_sql_list(HI_RES_CODES)})"


def sql_resource_tier(e: str) -> str:
    g = sql_gen_lang_metric(e)
    return (f"(CASE WHEN {g} IN {_sql_list(TIER_HIGH)} THEN 'high' WHEN {g} IN {_sql_list(TIER_MID)} THEN 'mid' "
            f"WHEN {g} IN {_sql_list(TIER_LOW)} THEN 'low' WHEN {g} IN {_sql_list(TIER_XLOW)} THEN 'xlow' "
            f"ELSE '?' END)")


def sql_resource_multiplier(e: str) -> str:
    g = sql_gen_lang_synth(e)
    return (f"CAST(CASE WHEN {g} IN {_sql_list(TIER_XLOW)} THEN {MULT_XLOW} WHEN {g} IN {_sql_list(TIER_LOW)} "
            f"THEN {MULT_LOW} ELSE {MULT_OTHER} END AS INTEGER)")


def sql_detect_code(e: str) -> str:
    whens = " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in DETECT_CODES)
    return f"(CASE {e} {whens} ELSE NULL END)"
