"""Toxic passages by maximum-scoring segments.

Tokens are words and their prefixes of ``PREFIX`` letters (marked ``*``), so
that inflected and joined forms share evidence.  Each token has the log-odds
of toxic against clean documents, with an informative Dirichlet prior (the
token's share of all labelled documents).  A word scores as its longest token
in the model, or 0.  A cost for each word, the mean score of clean words plus
``MARGIN``, makes the mean score of clean text negative, so a passage pays only
where toxic words are dense, and lambda (below) is positive.  One scan (Ruzzo
and Tompa) finds all maximal-scoring segments of a text.

The score of a segment is set against chance: in clean text of n words the
best segment's excess follows an extreme-value law, P(S >= s) = 1 -
exp(-K n exp(-lambda s)), with lambda from the clean words' score distribution
and K from clean training texts.  A document's score is a logistic function,
fitted on training rows, of its segments' surprise.

Copies are no further evidence: of labelled rows (at most ``COUNTED`` that may be
learned from, those with the smallest hash of the id, so that their ids may be
broadcast) that share a label and one of two MinHash values of their 3-word
n-grams only one is learned from.  The model keeps the ``VOCABULARY`` tokens of
largest z-score among those with log-odds of ``LEAST`` or more, and the
calibration is fitted on at most ``SAMPLE`` of the rows.  Documents are scored whole,
where they lie, without a shuffle.

Edge cases: a null or empty text, or one without words, has no segment and
gets the score of no evidence; without labelled rows of both labels every
score is the share of label 1 (0 without any row); repeated rows give equal
rows; other columns are not read; a null doc_id counts as held out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polytext.llm.common import held_out, known_labels, ship, stored
from polytext.llm.jaccard import shingles

VOCABULARY, COUNTED, SAMPLE, PRIOR, Z, LEAST, MARGIN, SIGNIFICANT = 20_000, 50_000, 10_000, 50.0, 4.0, 0.7, 0.03, 0.01
PREFIX = range(8, 2, -1)

#: Bytes: A-Z to a-z, other ASCII but letters to a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_TABLE).split()


def tokens(word: bytes) -> list[str]:
    """The word and its prefixes, the longest first."""
    said = word.decode("utf-8")
    return [said, *(f"{said[:n]}*" for n in PREFIX if n < len(said))]


def segments(scores: list[tuple[int, float]], cost: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, end word, score) of a text in
    which the words of ``scores`` (position, score) count their score less the
    cost, and every other word minus the cost.  Linear in the words given: a
    stack of candidates, each with the totals before and after it."""
    stack: list[tuple[int, int, float, float]] = []  # first, end, total before, total after
    total, at = 0.0, 0
    for i, s in scores:
        total -= cost * (i - at)
        at = i + 1
        if s <= cost:
            total += s - cost
            continue
        first, end, low, high = i, i + 1, total, total + s - cost
        total = high
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:  # before it, the total was no lower: it can't be joined
                j -= 1
            if j < 0 or stack[j][3] >= high:
                break
            first, low = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((first, end, low, high))
    return [(f, e, h - lo) for f, e, lo, h in stack]


@dataclass
class Model:
    odds: dict[str, float]
    prior: float = 0.0
    cost: float = MARGIN
    lam: float = 1.0
    k: float = 1.0
    slope: float = 0.0
    bias: float = 0.0

    def scored(self, text: str | None) -> tuple[int, list[tuple[int, float]]]:
        """Number of words, and (position, log-odds) of those in the model."""
        if not hasattr(self, "_seen"):
            self._seen: dict[bytes, float | None] = {}
        ws, seen = words(text), self._seen
        if len(seen) > 200_000:
            seen.clear()
        for w in set(ws).difference(seen):
            seen[w] = next((self.odds[t] for t in tokens(w) if t in self.odds), None)
        return len(ws), [(i, s) for i, w in enumerate(ws) if (s := seen[w]) is not None]

    def found(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and the maximal segments of a text."""
        n, known = self.scored(text)
        return n, segments(known, self.cost)

    def chance(self, n: int, s: float) -> float:
        """Probability that clean text of n words holds a segment of score s."""
        return -float(np.expm1(-self.k * max(n, 1) * np.exp(-self.lam * s)))

    def evidence(self, n: int, found) -> float:
        """Surprise of the best segment and, on top, of the other significant ones."""
        each = sorted((-np.log(max(self.chance(n, s), 1e-300)) for _, _, s in found), reverse=True)
        return float(np.log1p(sum(e for i, e in enumerate(each) if not i or e > -np.log(SIGNIFICANT))))

    def score(self, text: str | None) -> float:
        if not self.odds:
            return self.prior
        return float(1 / (1 + np.exp(-(self.bias + self.slope * self.evidence(*self.found(text))))))

    def significant(self, text: str | None) -> list[tuple[int, int, float, float]]:
        """Toxic passages: first word, end word, score, probability by chance."""
        n, found = self.found(text)
        return [(f, e, s, p) for f, e, s in found if (p := self.chance(n, s)) < SIGNIFICANT]


def lambda_of(scores: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(lambda * score)) = 1."""
    mean = lambda x: float((share * np.exp(np.minimum(x * scores, 700))).sum())
    low, high = 0.0, 1e-3
    while mean(high) < 1 and high < 1e3:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 1 else (low, mid)
    return (low + high) / 2


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias, by Newton steps with a small ridge."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + 1e-2 * np.eye(2), a.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def apart(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """doc_id, y of labelled rows without copies: rows of a label that share the
    least n-gram under one of two orders are represented by one of them."""

    def keyed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            least = [(int(s.min()), int((s * np.uint64(0xD6E8FEB86659FD93)).min())) if len(s) else (0, 0) for s in (shingles(t, 3) for t in p["text"])]
            yield pd.DataFrame({"doc_id": p["doc_id"], "y": p["y"], "k1": [a >> 1 for a, _ in least], "k2": [b >> 1 for _, b in least]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").join(known_labels(labels, "toxic", most), "doc_id").mapInPandas(keyed, f"doc_id {kind}, y int, k1 long, k2 long")
    for k in ("k1", "k2"):
        rows = rows.groupBy("y", k).agg(F.min(F.struct(F.xxhash64("doc_id"), "doc_id", "k2")).alias("r")).select("y", "r.doc_id", "r.k2")
    return stored(rows.select("doc_id", "y").distinct(), "labelled-apart")


def fit(docs: DataFrame, labels: DataFrame, vocabulary: int = VOCABULARY, sample: int = SAMPLE, most: int = COUNTED) -> Model:
    ship(docs.sparkSession)

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:  # in how many documents of a batch; the empty token stands for the document itself
            has = (Counter(), Counter())
            for t, y in zip(p["text"], p["y"]):
                has[y].update({"", *(x for w in set(words(t)) for x in tokens(w))})
            yield pd.DataFrame([(w, has[1][w], has[0][w]) for w in has[0].keys() | has[1].keys()], columns=["w", "toxic", "clean"])

    ids = apart(docs, labels, most)
    known = lambda n: docs.select("doc_id", "text").join(F.broadcast(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)), "doc_id")  # noqa: E731  at most ``most`` ids
    rows = (known(most).mapInPandas(counted, "w string, toxic long, clean long")
            .groupBy("w").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    rows = stored(rows.where("w = '' or toxic + clean > 1"), "token-counts")
    all_docs = rows.where("w = ''").first()
    if all_docs is None or not all_docs["toxic"] or not all_docs["clean"]:
        return Model({}, prior=0.0 if all_docs is None else float(all_docs["toxic"] > 0))
    n1, n0 = all_docs["toxic"], all_docs["clean"]
    a = F.lit(PRIOR) * (F.col("toxic") + F.col("clean")) / (n1 + n0)
    y1, y0 = F.col("toxic") + a, F.col("clean") + a
    odds = F.log(y1 / (n1 + PRIOR - y1)) - F.log(y0 / (n0 + PRIOR - y0))
    model = (rows.where((F.col("w") != "") & (y1 < n1 + PRIOR) & (y0 < n0 + PRIOR)).withColumn("odds", odds).withColumn("z", F.col("odds") / F.sqrt(1 / y1 + 1 / y0))
             .where((F.abs("z") >= Z) & (F.abs("odds") >= LEAST)).orderBy(F.desc(F.abs("z")), "w").limit(vocabulary).collect())
    m = Model({r["w"]: r["odds"] for r in model})

    def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got = [m.scored(t) for t in p["text"]]
            yield pd.DataFrame({"doc_id": p["doc_id"].astype(str), "y": p["y"], "n": [n for n, _ in got], "w": [[s for _, s in known] for _, known in got],
                                "p": [[i for i, _ in known] for _, known in got]})

    seen = known(sample).mapInPandas(best, "doc_id string, y int, n long, w array<double>, p array<int>").collect()  # at most ``sample`` ids
    seen = sorted(seen, key=lambda r: (r["doc_id"], r["n"]))
    clean = [r for r in seen if not r["y"]]
    scored, total = Counter(s for r in clean for s in r["w"]), max(1, sum(r["n"] for r in clean))
    if not clean or not any(s > 0 for s in m.odds.values()):
        return Model({}, prior=n1 / (n1 + n0))
    m.cost = max(0.0, sum(s * n for s, n in scored.items()) / total) + MARGIN
    m.lam = lambda_of(np.array([0.0, *scored]) - m.cost, np.array([total - scored.total(), *scored.values()]) / total)
    found = [segments(list(zip(r["p"], r["w"])), m.cost) for r in seen]
    best_of = lambda f: max((s for _, _, s in f), default=0.0)
    m.k = len(clean) / max(1e-12, sum(max(r["n"], 1) * np.exp(-m.lam * best_of(f)) for r, f in zip(seen, found) if not r["y"]))
    m.slope, m.bias = logistic(np.array([m.evidence(r["n"], f) for r, f in zip(seen, found)]), np.array([r["y"] for r in seen], dtype=float))
    return m


def score(text: Column, model: Model) -> Column:
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype=float)

    return run(text)


def passages(text: Column, model: Model) -> Column:
    """array<struct<first, end, score, chance>>: significant passages, in words."""

    @F.pandas_udf("array<struct<first:int,end:int,score:double,chance:double>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("first", "end", "score", "chance"), x)) for x in model.significant(t)] for t in texts])

    return run(text)


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
