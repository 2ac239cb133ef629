"""Fixture views: the driver tables re-shaped into the reference's record kinds.

Every view exists twice with the same definition: a Spark builder (used by the
registered queries) and DuckDB SQL text (used by the oracle).  All views keep
whole document texts; nothing is cut, sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polytext.functions.langs import sql_str

# Twenty language labels (fixture choice) covering every resource tier, the
# Estonian suffix rules, a 'bible' source, a zero-weight high language and an
# unknown language.
LABELS20 = ["Livonian, Standard", "Proper Karelian, Tolmachi", "Estonian, ocr", "Estonian, Hiiu", "English",
            "Russian, bible", "Komi", "Udmurt, Standard", "Finnish", "Veps", "Latvian", "Klingon",
            "Hungarian, speech", "Estonian", "Võro", "Swedish", "Norwegian", "Northern Sami",
            "Ludian, dictionary", "German"]

TASKS = ["translate", "approx-translate", "generate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _label(k) -> F.Column:
    return F.element_at(F.array(*[F.lit(x) for x in LABELS20]), (k + 1).cast("int"))


def segs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_segs: one whole document text per segment."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", "source", F.col("text").alias("seg"), (F.col("doc_id") % 20).alias("k"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_entries: translation entries pairing document i with document i+1."""
    s = segs(spark, sf_dir).alias("s")
    t = segs(spark, sf_dir).select(F.col("doc_id").alias("t_id"), F.col("seg").alias("t_seg"),
                                  F.col("lang").alias("t_lang"))
    j = s.join(t, F.col("t_id") == F.col("s.doc_id") + 1, "inner")
    m3 = F.col("doc_id") % 3
    return j.select(
        F.col("doc_id"),
        F.element_at(F.array(*[F.lit(x) for x in TASKS]), (m3 + 1).cast("int")).alias("task"),
        F.col("seg").alias("src_segm"),
        F.when(m3 == 2, F.lit(None).cast("string")).when(F.col("doc_id") % 29 == 0, F.lit(""))
        .otherwise(F.col("t_seg")).alias("tgt_segm"),
        _label(F.col("k")).alias("src_lang"),
        _label((F.col("k") * 7 + 3) % 20).alias("tgt_lang"),
        F.col("lang").alias("src_doc_lang"),
        F.col("t_lang").alias("tgt_doc_lang"),
    )


def hyps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v_hyps: entries with a model hypothesis of known kind (by doc_id % 7)
    and the language the hypothesis text is really in (a perfect detector)."""
    e = entries(spark, sf_dir)
    m7 = F.col("doc_id") % 7
    tgt = F.col("tgt_segm")
    rev = F.array_join(F.reverse(F.split(tgt, " ")), " ")
    hyp = (F.when(m7 == 0, tgt).when(m7 == 1, F.concat(tgt, F.lit("?"))).when(m7 == 2, rev)
           .when(m7 == 3, F.lit("")).when(m7 == 4, F.col("src_segm"))
           .otherwise(F.coalesce(tgt, F.col("src_segm"))))
    hyp_lang = (F.when(m7 == 3, F.lit("none")).when(m7 == 4, F.col("src_doc_lang"))
                .when((m7 >= 5) & tgt.isNull(), F.col("src_doc_lang")).otherwise(F.col("tgt_doc_lang")))
    return e.select("*", F.coalesce(hyp, F.lit("")).alias("hyp_output"),
                    F.col("doc_id").alias("hyp_index"), hyp_lang.alias("hyp_lang"))


# ---------------------------------------------------------------------------
# DuckDB text of the same views
# ---------------------------------------------------------------------------

def _sql_label(k: str) -> str:
    return "([" + ", ".join(sql_str(x) for x in LABELS20) + f"])[{k} + 1]"


SQL_VIEWS: dict[str, tuple[list[str], str]] = {
    "v_segs": ([], "SELECT doc_id, lang, source, text AS seg, doc_id % 20 AS k FROM documents"),
    "v_entries": (["v_segs"], f"""
        SELECT s.doc_id,
          (['translate', 'approx-translate', 'generate'])[s.doc_id % 3 + 1] AS task,
          s.seg AS src_segm,
          CASE WHEN s.doc_id % 3 = 2 THEN NULL WHEN s.doc_id % 29 = 0 THEN '' ELSE t.seg END AS tgt_segm,
          {_sql_label('s.k')} AS src_lang,
          {_sql_label('(s.k * 7 + 3) % 20')} AS tgt_lang,
          s.lang AS src_doc_lang, t.lang AS tgt_doc_lang
        FROM v_segs s JOIN v_segs t ON t.doc_id = s.doc_id + 1"""),
    "v_hyps": (["v_entries"], """
        SELECT *,
          coalesce(CASE doc_id % 7 WHEN 0 THEN tgt_segm WHEN 1 THEN tgt_segm || '?'
               WHEN 2 THEN array_to_string(list_reverse(string_split(tgt_segm, ' ')), ' ')
               WHEN 3 THEN '' WHEN 4 THEN src_segm ELSE coalesce(tgt_segm, src_segm) END, '') AS hyp_output,
          doc_id AS hyp_index,
          CASE WHEN doc_id % 7 = 3 THEN 'none' WHEN doc_id % 7 = 4 THEN src_doc_lang
               WHEN doc_id % 7 >= 5 AND tgt_segm IS NULL THEN src_doc_lang ELSE tgt_doc_lang END AS hyp_lang
        FROM v_entries"""),
}


def register_sql_view(name: str, deps: list[str], sql: str) -> None:
    SQL_VIEWS[name] = (deps, sql)


def with_views(body: str, *names: str, ctes: str | None = None) -> str:
    """Prefix ``body`` with the CTEs of the named views (and their deps),
    followed by the extra CTE text ``ctes`` (``a AS (...), b AS (...)``)."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in SQL_VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({SQL_VIEWS[n][1]})" for n in order]
    if ctes:
        parts.append(ctes.strip().strip(","))
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body


# ---- v_alpaca: a user turn and the assistant turn after it -> instruction entry
ALPACA_INSTRUCTION = "Answer the user's message."


def alpaca(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("input"))
    a = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                     F.col("text").alias("output"))
    return u.join(a, ["conv_id", "turn"], "inner").select(
        "conv_id", "turn", F.lit(ALPACA_INSTRUCTION).alias("instruction"), "input", "output")


register_sql_view("v_alpaca", [], f"""
    SELECT u.conv_id, u.turn, {sql_str(ALPACA_INSTRUCTION)} AS instruction, u.text AS input, a.text AS output
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE u.role = 'user' AND a.role = 'assistant'""")


# ---- v_tuples: three consecutive documents form one n-way tuple
# (est, liv, rus), with a 'liv-dia' key (the Livonian document's source) on
# even Livonian documents and a blank value on every 13th document.  Category
# = block of 100 tuples (bounded), position = tuple id.
TUPLE_KEYS = ["est", "liv", "rus"]


def tuple_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    tid = F.floor(F.col("doc_id") / 3).cast("bigint")
    items = d.select(tid.alias("tuple_id"),
                     F.element_at(F.array(*[F.lit(x) for x in TUPLE_KEYS]), (F.col("doc_id") % 3 + 1).cast("int"))
                     .alias("key"),
                     F.when(F.col("doc_id") % 13 == 0, F.lit("   ")).otherwise(F.col("text")).alias("value"))
    dia = d.where((F.col("doc_id") % 3 == 1) & (F.col("doc_id") % 2 == 0)).select(
        tid.alias("tuple_id"), F.lit("liv-dia").alias("key"), F.col("source").alias("value"))
    return items.unionByName(dia)


def tuples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, pos, tuple_id, m map<string,string>); each map has at most four keys."""
    it = tuple_items(spark, sf_dir)
    return it.groupBy("tuple_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m")) \
        .select(F.concat(F.lit("cat"), F.floor(F.col("tuple_id") / 100).cast("string")).alias("source"),
                F.col("tuple_id").alias("pos"), "tuple_id", "m")


register_sql_view("v_tuple_items", [], """
    SELECT doc_id // 3 AS tuple_id, (['est', 'liv', 'rus'])[doc_id % 3 + 1] AS key,
      CASE WHEN doc_id % 13 = 0 THEN '   ' ELSE text END AS value FROM documents
    UNION ALL
    SELECT doc_id // 3, 'liv-dia', source FROM documents WHERE doc_id % 3 = 1 AND doc_id % 2 = 0""")


# ---- v_script: whole texts, every third with Latin letters swapped for their
# Cyrillic look-alikes, and a language code of several styles by doc_id % 5.
SCRIPT_CODES = ["est", "rus", "udm", "<2lv>", "xx"]
HOMOGLYPHS_LATIN, HOMOGLYPHS_CYRILLIC = "aeocp", "аеоср"


def script_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", "lang",
        F.element_at(F.array(*[F.lit(x) for x in SCRIPT_CODES]), (F.col("doc_id") % 5 + 1).cast("int")).alias("code"),
        F.when(F.col("doc_id") % 3 == 0, F.translate("text", HOMOGLYPHS_LATIN, HOMOGLYPHS_CYRILLIC))
        .otherwise(F.col("text")).alias("text"))


register_sql_view("v_script", [], f"""
    SELECT doc_id, lang, ([{', '.join(sql_str(x) for x in SCRIPT_CODES)}])[doc_id % 5 + 1] AS code,
      CASE WHEN doc_id % 3 = 0 THEN translate(text, '{HOMOGLYPHS_LATIN}', '{HOMOGLYPHS_CYRILLIC}') ELSE text END AS text
    FROM documents""")


# ---- v_codes: language codes found in the data, in every code style
def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = script_rows(spark, sf_dir)
    return s.select("doc_id", F.explode(F.array(
        F.col("code"), F.col("lang"), F.concat("lang", F.lit("_Latn")), F.concat(F.lit("<2"), "lang", F.lit(">")))
    ).alias("raw_code"))


register_sql_view("v_codes", ["v_script"], """
    SELECT doc_id, unnest([code, lang, lang || '_Latn', '<2' || lang || '>']) AS raw_code FROM v_script""")


# ---- v_sents: train sentences (documents) and dev sentences (benchmark, one
# copy per fixture language, as a parallel dev set)
DEV_LANGS = ["en", "fr", "de", "es"]


def train_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polytext.operators.contamination import sentences
    from polytext.operators.layout import spread
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    return d.select("doc_id", "lang", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))


def dev_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from polytext.operators.contamination import sentences
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.explode(sentences(F.col("text"))).alias("sentence")) \
        .select("item_id", "sentence", F.explode(F.array(*[F.lit(x) for x in DEV_LANGS])).alias("lang"))


_SQL_SENTS = "list_filter(list_transform(regexp_split_to_array({t}, '[.\\n]+'), lambda s: trim(s)), lambda s: s <> '')"
register_sql_view("v_doc_sents", [], f"""
    SELECT doc_id, lang, {_SQL_SENTS.format(t='text')} AS sents FROM documents""")
register_sql_view("v_sents", ["v_doc_sents"], """
    SELECT doc_id, lang, unnest(sents) AS sentence FROM v_doc_sents""")
register_sql_view("v_dev", [], f"""
    SELECT item_id, sentence, unnest({DEV_LANGS!r}) AS lang
    FROM (SELECT item_id, unnest({_SQL_SENTS.format(t='text')}) AS sentence FROM benchmark)""")


# ---- v_tokens: lower-cased non-space tokens of the whole documents
register_sql_view("v_tokens", [], r"""
    SELECT doc_id, pos - 1 AS pos, token FROM documents,
      unnest(regexp_extract_all(lower(text), '[^\s]+')) WITH ORDINALITY AS u(token, pos)""")
register_sql_view("v_freq", ["v_tokens"], """
    SELECT token, count(*) AS count, arg_min(doc_id, (doc_id, pos)) AS first_doc, min((doc_id, pos)) AS first
    FROM v_tokens GROUP BY token""")
register_sql_view("v_vocab", ["v_freq"], """
    SELECT token, CAST(3 + row_number() OVER (ORDER BY first) AS INTEGER) AS id FROM v_freq
    WHERE count >= 2 AND token NOT IN ('<s>', '<pad>', '</s>', '<unk>')
    UNION ALL SELECT * FROM (VALUES ('<s>', 0), ('<pad>', 1), ('</s>', 2), ('<unk>', 3)) t(token, id)""")


# ---- v_batches: documents with character length and two bins
def batch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", F.char_length("text").alias("n_chars"),
                    (F.col("doc_id") % 2).cast("int").alias("src_bin"),
                    (F.col("doc_id") % 3 % 2).cast("int").alias("tgt_bin"))


register_sql_view("v_batches", [], """
    SELECT doc_id, lang, length(text) AS n_chars, CAST(doc_id % 2 AS INTEGER) AS src_bin,
      CAST(doc_id % 3 % 2 AS INTEGER) AS tgt_bin FROM documents""")
