"""URL filter: rules first, then logistic regression on hashed n-grams.

A rule names a host and a path prefix; it fits the host and its subdomains,
and the longest fitting rule decides.  Other URLs are judged by logistic
regression on hashed character n-grams of host and path, trained from a small
table of labelled URLs.

Everything is DataFrame expressions: n-grams are substrings hashed to
``BUCKETS`` numbers, training is one aggregate a step over the small table
(``LABELLED`` rows at most) with the weights, a list of fixed length, as a
literal; scoring sums the weights of a URL's buckets.  No shuffle of pages.

Edge cases: a null URL, or one without ``://``, has an empty host and path and
is judged by the bias alone; repeated rows give equal rows; other columns are
not read; without labelled rows of both labels every weight is 0 and the
verdict is ``allow``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, LABELLED, STEPS, RATE, DECAY = 4096, 2000, 12, 4.0, 1e-3

#: Fixed values: (host, path prefix, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UP, _LOW), path


def rule_columns(host: Column, path: Column, rules=None) -> tuple[Column, Column]:
    """The longest fitting rule (longest host, then path) and its verdict; null
    if none fits."""
    rules = sorted(RULES if rules is None else rules, key=lambda r: (-len(r[0] + r[1]), r))
    said = verdict = None
    for h, p, v in rules:
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        said = F.when(fits, h + p) if said is None else said.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return said, verdict


def buckets(host: Column, path: Column, n: int = 3) -> Column:
    """Distinct buckets of the character n-grams of host and path, marked by
    the part they come from."""
    def grams(mark: str, text: Column) -> Column:
        text = F.concat(F.lit("^"), text, F.lit("$"))
        return F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - (n - 1))),
                           lambda i: (F.pmod(F.xxhash64(F.lit(mark), F.substring(text, i, F.lit(n))), F.lit(BUCKETS)) + 1).cast("int"))

    return F.array_distinct(F.concat(grams("h", host), grams("p", path)))


def probability(grams: Column, weights: list[float], bias: float) -> Column:
    """Probability of the label ``block``."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded to one literal
    total = F.aggregate(grams, F.lit(float(bias)), lambda a, g: a + F.element_at(table, g))
    return 1 / (1 + F.exp(-total))


def train(labelled: DataFrame, steps: int = STEPS) -> tuple[list[float], float]:
    """Weights and bias from ``labelled`` (host, path, y: 1 for block).  Each
    step is one aggregate that returns a row for each bucket."""
    data = labelled.select(buckets(F.col("host"), F.col("path")).alias("g"), "y").cache()
    weights, bias = [0.0] * BUCKETS, 0.0
    n, ones = data.agg(F.count("*"), F.sum("y")).first()
    if not n or not ones or ones == n:
        return weights, bias
    for _ in range(steps):
        # the step is divided by a URL's number of n-grams, so it does not overshoot
        error = data.withColumn("e", F.col("y") - probability(F.col("g"), weights, bias)).withColumn("e", F.struct("e", (F.col("e") / F.size("g")).alias("s")))
        rows = (error.select(F.explode(F.concat("g", F.array(F.lit(0)))).alias("g"), "e").groupBy("g").agg(F.sum("e.e").alias("all"), F.sum("e.s").alias("s")).collect())
        slopes = {r["g"]: r for r in rows}
        bias += RATE * slopes[0]["all"] / n
        weights = [w * (1 - DECAY) + (RATE * 32 * slopes[i + 1]["s"] / n if i + 1 in slopes else 0.0) for i, w in enumerate(weights)]
    data.unpersist()
    return weights, bias


def judge(pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score (probability of ``block``) of
    each page.  Without a table of labelled URLs, one is taken from the pages
    that a rule decides: the ``LABELLED`` rows with the smallest hash."""
    host, path = parts(F.col("url"))
    split = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"))
    ruled = split.withColumn("rule", rule).withColumn("by_rule", verdict)
    if labelled is None:
        known = ruled.where("by_rule is not null").select("host", "path", (F.col("by_rule") == "block").cast("int").alias("y")).distinct()
        labelled = known.orderBy(F.xxhash64("host", "path"), "host", "path").limit(LABELLED)
    weights, bias = train(labelled)
    score = probability(buckets(F.col("host"), F.col("path")), weights, bias)
    return (ruled.withColumn("score", score)
            .select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score"))
