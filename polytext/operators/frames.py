"""Arrow batches in slices.

Spark bounds the bytes of a batch that it sends to Python, but what a task makes
of it (Python strings, codes, outputs) takes several times as much.  Operators
therefore work on slices of a batch, so that a task holds one batch and what
belongs to one slice, however large the table is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20


def cuts(size: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(first, end) of runs of rows whose sizes add up to at most ``most``; a
    larger row is a run of its own."""
    upto, out, at = np.cumsum(size, dtype=np.int64), [], 0
    while at < len(size):
        before = int(upto[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + most, "right")))
        out.append((at, end))
        at = end
    return out


def text_bytes(*columns: pa.Array) -> np.ndarray:
    """Bytes of each row's texts and one more."""
    size = 1
    for c in columns:
        size = size + pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return size


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes in column ``text``."""
    for b in batches:
        for first, end in cuts(text_bytes(b.column(text)), most):
            yield b.slice(first, end - first)
