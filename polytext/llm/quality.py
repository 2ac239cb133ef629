"""Quality classifier: histogram gradient-boosted trees over document statistics.

Each text gives a fixed list of statistics (``NAMES``).  Trees are grown level
by level on binned values: a histogram of gradients and curvatures for each
node, feature and bin gives the best split.  The finished trees are flattened
into arrays, and a batch of documents walks all trees at once in numpy.

The trees are fitted on at most ``SAMPLE`` labelled rows, those with the
smallest hash of the id, so the driver holds a bounded matrix; every document
is scored where it lies, whole, without a shuffle.

Edge cases: a null or empty text has all statistics 0 and a score like any
other; without labelled rows of both labels every score is the share of label
1 (0.5 without any row); repeated rows give equal rows; other columns are not
read; a null doc_id counts as held out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polytext.llm.common import held_out, labelled_texts, ship

SAMPLE, TREES, DEPTH, BINS, RATE, LEAF_ROWS, RIDGE = 20_000, 80, 4, 64, 0.1, 8, 1.0
KEEP = 0.3

NAMES = ("log_bytes", "log_words", "upper", "lower", "digits", "spaces", "stops", "marks", "symbols", "bars", "bangs", "beyond_ascii", "byte_entropy",
         "word_mean", "word_longest", "words_distinct", "word_top", "pairs_distinct", "log_lines", "lines_distinct", "line_mean", "lines_short", "capital_words", "joined_marks")


def _cells(said: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(said))


_CLASS = np.stack([_cells(c) for c in (
    bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b" \t", b".,;:?'\"()-", b"!", b"#$%&*+=<>@[]\\^_`{}~/", b"|", bytes(range(128, 256)))]).astype(float)


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8")
    if not raw:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    upper, lower, digits, spaces, marks, bangs, symbols, bars, beyond = _CLASS @ counts / n
    p = counts[counts > 0] / n
    words = raw.split()
    lines = raw.split(b"\n")
    nw = max(1, len(words))
    own, pairs = Counter(words), set(zip(words, words[1:]))
    joined = sum(v for w, v in own.items() if len(w) > 1 and not w[-1:].isalnum() and not w[-2:-1].isalnum() and w[-1] < 128 and w[-2] < 128)
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), upper, lower, digits, spaces, counts[46] / nw, marks, symbols, bars, bangs, beyond, float(-(p * np.log(p)).sum()),
        sum(len(w) * v for w, v in own.items()) / nw, float(max(map(len, own), default=0)), len(own) / nw, max(own.values(), default=0) / nw, len(pairs) / max(1, len(words) - 1),
        float(np.log1p(len(lines))), len(set(lines)) / len(lines), n / len(lines), sum(len(x) < 30 for x in lines) / len(lines),
        sum(v for w, v in own.items() if w[:1].isupper()) / nw, joined / nw,
    ]


@dataclass
class Trees:
    """All nodes of all trees in arrays; a leaf points to itself."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        if not len(x):
            return np.empty(0)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Boosted trees for labels ``y`` (0 or 1)."""
    mean = float(y.mean()) if len(y) else 0.5
    if mean in (0.0, 1.0) or not len(y):
        mean, trees = min(max(mean, 0.0), 1.0), 0
    base = float(np.clip(np.log(max(mean, 1e-9) / max(1 - mean, 1e-9)), -20, 20))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])] if trees else []
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1) if trees else None
    feature, cut, left, right, value, roots = [], [], [], [], [], []

    def node(v: float) -> int:
        i = len(value)
        feature.append(0), cut.append(np.inf), left.append(i), right.append(i), value.append(v)
        return i

    said = np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-said))
        g, h = y - p, p * (1 - p)
        leaf = lambda rows: RATE * float(g[rows].sum() / (h[rows].sum() + RIDGE))  # noqa: B023, E731
        level = [(node(leaf(np.arange(len(y)))), np.arange(len(y)))]
        roots.append(level[0][0])
        done = []
        for _ in range(depth):
            below = []
            for at, rows in level:
                best = None
                if len(rows) >= 2 * LEAF_ROWS:
                    gs, hs = g[rows], h[rows]
                    whole = gs.sum() ** 2 / (hs.sum() + RIDGE)
                    for f, e in enumerate(edges):
                        if not len(e):
                            continue
                        b = binned[rows, f]
                        m = len(e) + 1
                        gl, hl, nl = (np.cumsum(np.bincount(b, w, m))[:-1] for w in (gs, hs, None))
                        gain = gl**2 / (hl + RIDGE) + (gs.sum() - gl) ** 2 / (hs.sum() - hl + RIDGE) - whole
                        gain[(nl < LEAF_ROWS) | (len(rows) - nl < LEAF_ROWS)] = -1
                        i = int(gain.argmax())
                        if gain[i] > 1e-6 and (best is None or gain[i] > best[0]):
                            best = gain[i], f, i
                if best is None:
                    done.append((at, rows))
                    continue
                _, f, i = best
                goes = binned[rows, f] <= i
                feature[at], cut[at] = f, float(edges[f][i])
                for part, side in ((rows[goes], left), (rows[~goes], right)):
                    side[at] = node(leaf(part))
                    below.append((side[at], part))
            level = below
        for at, rows in done + level:
            said[rows] += value[at]
    as_int = lambda v: np.array(v, dtype=np.int64)
    return Trees(base, as_int(roots), as_int(feature), np.array(cut), as_int(left), as_int(right), np.array(value), depth)


def matrix(texts) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=float).reshape(-1, len(NAMES))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    ship(docs.sparkSession)

    def measured(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({"doc_id": p["doc_id"].astype(str), "y": p["y"], "x": list(matrix(p["text"]))})

    rows = labelled_texts(docs, labels, "quality", sample).mapInPandas(measured, "doc_id string, y int, x array<double>").collect()  # at most ``sample`` ids
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["x"]))
    return grow(np.array([r["x"] for r in rows]).reshape(-1, len(NAMES)), np.array([r["y"] for r in rows], dtype=float))


def score(text: Column, trees: Trees) -> Column:
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([trees.score(matrix(texts.iloc[i:i + 512])) for i in range(0, len(texts), 512)]) if len(texts) else [], dtype=float)

    return run(text)


def classify(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return (docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), trees).alias("score"))
            .withColumn("predicted", (F.col("score") >= KEEP).cast("int")))
