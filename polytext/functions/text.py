"""Text Column builders: white-space handling, the 13a word tokeniser used by
corpus BLEU, and n-gram arrays.  All JVM-side regex / higher-order functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(x) -> Column:
    """Python ``str.strip()``: trims Unicode white space at both ends."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def remove_ws(x) -> Column:
    """``''.join(s.split())``: all white space removed."""
    return F.regexp_replace(_c(x), r"(?U)\s+", "")


# ---------------------------------------------------------------------------
# 13a tokeniser (the mteval-v13a rules as published with sacreBLEU, Post 2018).
# The rule order and character classes of that tokeniser.
# ---------------------------------------------------------------------------
_13A_PLAIN = [("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"),
              ("&gt;", ">")]
_13A_PUNCT = r"([{-~\[-` -&(-+:-@/])"
_13A_RULES = [
    (_13A_PUNCT, " {1} "),
    (r"([^0-9])([\.,])", "{1} {2} "),
    (r"([\.,])([^0-9])", " {1} {2}"),
    (r"([0-9])(-)", "{1} {2} "),
]


def tok13a(x) -> Column:
    """13a-tokenised text (single spaces, no leading/trailing space)."""
    c = F.regexp_replace(_c(x), r"(?U)\s+$", "")  # rstrip
    for a, b in _13A_PLAIN:
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.concat(F.lit(" "), c, F.lit(" "))
    for pat, rep in _13A_RULES:
        c = F.regexp_replace(c, pat, rep.replace("{1}", "$1").replace("{2}", "$2"))
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def split_tokens(tokenised) -> Column:
    """Space-separated tokens; the empty string gives an empty array.  The
    input is referenced once, so an expensive tokeniser expression is not
    evaluated twice."""
    return F.array_remove(F.split(_c(tokenised), " "), "")


# ---- DuckDB text of the same functions ----

def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_tok13a(e: str) -> str:
    c = f"regexp_replace({e}, '\\s+$', '')"
    for a, b in _13A_PLAIN:
        a_sql = _q(a).replace("\n", "' || chr(10) || '")
        c = f"replace({c}, {a_sql}, {_q(b)})"
    c = f"(' ' || {c} || ' ')"
    for pat, rep in _13A_RULES:
        c = f"regexp_replace({c}, {_q(pat)}, {_q(rep.replace('{1}', chr(92) + '1').replace('{2}', chr(92) + '2'))}, 'g')"
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def sql_remove_ws(e: str) -> str:
    return f"regexp_replace({e}, '\\s+', '', 'g')"


def sql_split_tokens(e: str) -> str:
    return f"(CASE WHEN {e} = '' THEN []::VARCHAR[] ELSE string_split({e}, ' ') END)"
