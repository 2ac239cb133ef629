"""Fill-in-middle transformation with a sparse index of multibyte characters.

A text is cut into n units (``token``: ``[A-Za-z]+|[^A-Za-z]`` from left to
right; ``char``: one code point each) and divided into prefix, middle and
suffix at two cuts drawn from the sha256 of ``seed:id``; the parts are put
behind the sentinels ``<P>``, ``<S>`` and ``<M>`` in one of two orders (psm,
spm), or the text stays as it is (plain).

Texts are handled as UTF-8 bytes.  ``Index`` holds an entry for each multibyte
character only: its place in code points and in bytes, and the excess bytes up
to it.  A cut is converted between code points and bytes by one binary search
in these entries; in ASCII spans it is plain arithmetic, and a text without
multibyte characters has an empty index.  Units are found block by block
(``BLOCK`` bytes), so beside the text and its index nothing grows with it.

Each document is transformed where it lies, without a shuffle; frames are sent
on after ``FRAME`` bytes of output, so long texts don't pile up.

Edge cases: a null or empty text has 0 units, stays plain and gives an empty
output; a text that holds a sentinel stays plain; a null id draws as an empty
one; a middle (or any part) may be empty; repeated rows give equal rows; other
columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polytext.llm.common import ship

SENTINELS = ("<P>", "<S>", "<M>")
P, S, M = (x.encode() for x in SENTINELS)
BLOCK, FRAME = 1 << 20, 8 << 20
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class Index:
    """The multibyte characters of a UTF-8 text: bytes and code points they
    start at, and the excess bytes of those before each."""

    def __init__(self, data: bytes):
        b = np.frombuffer(data, np.uint8)
        self.size = len(b)
        self.byte = np.empty(0, np.int64) if data.isascii() else np.flatnonzero(b >= 0xC0)
        lead = b[self.byte]
        self.excess = np.concatenate([[0], np.cumsum(1 + (lead >= 0xE0) + (lead >= 0xF0), dtype=np.int64)])
        self.point = self.byte - self.excess[:-1]

    def points(self, byte: int) -> int:
        """Code points before a byte that starts a character (or ends the text)."""
        return int(byte - self.excess[np.searchsorted(self.byte, byte)])

    def bytes(self, point: int) -> int:
        """Byte at which a code point starts."""
        return int(point + self.excess[np.searchsorted(self.point, point)])


def _starts(b: np.ndarray, at: int) -> np.ndarray:
    """Which bytes of a block start a token."""
    part = b[at:at + BLOCK]
    letter = _LETTER[part]
    new = (part & 0xC0) != 0x80
    new[1:] &= ~(letter[1:] & letter[:-1])
    if at and letter[0] and _LETTER[b[at - 1]]:
        new[0] = False
    return new


def cuts(data: bytes, index: Index, draws: tuple[int, int], unit: str) -> tuple[int, int, int]:
    """Units of the text, and the bytes of its two cuts."""
    if unit == "char":
        n = index.points(len(data))
        return n, *(index.bytes(x) for x in sorted(d % (n + 1) for d in draws))
    b = np.frombuffer(data, np.uint8)
    blocks = range(0, len(b), BLOCK)
    counts = np.cumsum([0, *(np.count_nonzero(_starts(b, at)) for at in blocks)])
    n = int(counts[-1])

    def byte(u: int) -> int:
        if u == n:
            return len(b)
        k = int(np.searchsorted(counts, u, "right")) - 1
        return k * BLOCK + int(np.flatnonzero(_starts(b, k * BLOCK))[u - counts[k]])

    return n, *(byte(x) for x in sorted(d % (n + 1) for d in draws))


def transform(data: bytes, key: str, rate: int = 90, spm: int = 20, seed: int = 1, unit: str = "token") -> tuple:
    """n, form, output, and of the prefix and the middle the code points (None
    if plain) of a text in UTF-8.  ``rate`` and ``spm`` are percentages."""
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    index = Index(data)
    n, a, b = cuts(data, index, (h1, h2), unit)
    if not data or h3 % 100 >= rate or any(x in data for x in (P, S, M)):
        return n, "plain", data, None, None
    parts = [P, data[:a], S, data[b:], M, data[a:b]]
    form = "spm" if h4 % 100 < spm else "psm"
    out = parts if form == "psm" else parts[2:4] + parts[:2] + parts[4:]
    return n, form, b"".join(out), index.points(a), index.points(b) - index.points(a)


def infill(docs: DataFrame, rate: int = 90, spm: int = 20, seed: int = 1, unit: str = "token") -> DataFrame:
    """doc_id, n, form, output, prefix_chars, middle_chars of every document."""
    if unit not in ("token", "char"):
        raise ValueError("unit is token or char")
    ship(docs.sparkSession)
    columns = ["n", "form", "output", "prefix_chars", "middle_chars"]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            first, size, rows = 0, 0, []
            for i, (key, t) in enumerate(zip(p["key"], p["text"]), 1):
                rows.append(transform(t or b"", key or "", rate, spm, seed, unit))
                size += len(rows[-1][2])
                if size >= FRAME or i == len(p):
                    out = pd.DataFrame(rows, columns=columns).astype({"prefix_chars": "Int64", "middle_chars": "Int64"})
                    out.insert(0, "doc_id", p["doc_id"].iloc[first:i].to_numpy())
                    yield out
                    first, size, rows = i, 0, []

    rows = docs.select("doc_id", F.col("doc_id").cast("string").alias("key"), F.col("text").cast("binary").alias("text"))
    out = rows.mapInPandas(run, f"doc_id {kind}, n long, form string, output binary, prefix_chars long, middle_chars long")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(form: Column, output: Column) -> Column:
    """The text, rebuilt from form and output alone: behind the three sentinels
    stand prefix, suffix, middle (psm) or suffix, prefix, middle (spm)."""
    part = F.split(output, "<[PSM]>")
    psm, spm = (F.concat(*(part[i] for i in order)) for order in ((1, 3, 2), (2, 3, 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(rows: DataFrame) -> DataFrame:
    """The columns op13 returns."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
                       sha(restored(F.col("form"), F.col("output"))).alias("restored_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w,
                  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
g AS (SELECT *, len(w) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || h[i:i + 7] AS BIGINT)) AS g FROM d),
c AS (SELECT *, least(g[1] % (n + 1), g[2] % (n + 1)) AS a, greatest(g[1] % (n + 1), g[2] % (n + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR g[3] % 100 >= 90 THEN 'plain' WHEN g[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, array_to_string(w[1:a], '') AS pre, array_to_string(w[a + 1:b], '') AS mid, array_to_string(w[b + 1:n], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
