"""SentencePiece encoding with byte spans of the original text.

The normaliser takes the longest prefix in the model's compiled character map
(a double-array trie followed by the replacement strings), writes its
replacement and records for each output character the source byte it came
from.  The normalised text is cut into pieces by the model's vocabulary, with
its own normaliser switched off, and each piece is projected through that
alignment to a byte span of the original text.

A document is encoded on its own (no shuffle), in one piece however long.  A
null or empty text has no ids and decodes to an empty text.  Repeated rows
give equal rows; other columns are not read.  The model's path is a parameter:
it must be readable on every executor (as an installed package's file is).
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Ids of a frame sent on.
FRAME = 1 << 18


class CharMap:
    """The compiled character map of a normaliser."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{n // 4}I", blob, 4) if n else ()
        self.strings = blob[4 + n:] if n else b""

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts at ``at``, and its replacement."""
        if not self.units:
            return None
        u, best = self.units, None
        unit = u[0]
        node = self._offset(unit)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(u):
                break
            unit = u[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                best = (i + 1 - at, u[node] & 0x7FFFFFFF)
        if best is None:
            return None
        end = self.strings.index(0, best[1])
        return best[0], self.strings[best[1]:end]

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 0x200) >> 6)


class Pieces:
    """Encoder and decoder made from a model's serialised form."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models with escaped white space before a word are read")
        if any(p.type == 4 for p in proto.pieces):
            raise ValueError("models with user-defined pieces are not read")
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.map, self.prefix, self.squeeze = CharMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.piece = [p.piece for p in proto.pieces]
        self.decimal = [str(i) for i in range(len(self.piece))]
        self.takes = np.array([len(p.piece) if p.type != 6 else int(int(p.piece[1:-1], 16) & 0xC0 != 0x80) for p in proto.pieces], np.int64)  # characters; of byte pieces, those that start one
        self.is_byte = np.array([p.type == 6 for p in proto.pieces])
        self.byte = {i: int(p.piece[1:-1], 16) for i, p in enumerate(proto.pieces) if p.type == 6}
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces = b"", False, False
        self.cutter = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def normalise(self, text: str) -> tuple[str, list[int] | None]:
        """The text pieces are taken from, and for each of its characters (and
        its end) the byte of ``text`` it starts at; None for the plain alignment."""
        if not text:
            return "", [0]
        if not self.map.units and not self.squeeze:
            return MARK * self.prefix + text.replace(" ", MARK), None
        data, out, at, i = text.encode("utf-8"), [], [], 0
        while i < len(data):
            got = self.map.longest(data, i)
            if got is None:
                b = data[i]
                n = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                got = n, data[i:i + n]
            for c in got[1].decode("utf-8"):
                if not (self.squeeze and c == " " and (not out or out[-1] == " ")):
                    out.append(c)
                    at.append(i)
            i += got[0]
        end = i
        while self.squeeze and out and out[-1] == " ":
            out.pop()
            end = at.pop()
        if self.prefix and out:
            out.insert(0, " ")
            at.insert(0, at[0])
        return "".join(out).replace(" ", MARK), [*at, end]

    def ids(self, texts) -> list[list[int]]:
        """Ids of each text; None counts as empty."""
        return self.cutter.encode([self.normalise(t or "")[0] for t in texts], num_threads=1)

    def coded(self, text: str | None) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids of the pieces, and the first and end byte of each in the UTF-8 form
        of ``text``.  Byte pieces of a character all get the character's span."""
        text = text or ""
        norm, at = self.normalise(text)
        ids = self.cutter.encode(norm)
        own = np.array(ids, np.int32)
        takes = self.takes[own]
        unknown = own == self.processor.unk_id()
        if unknown.any():  # only these need the piece itself for its length
            said = self.cutter.encode(norm, out_type=str)
            takes[unknown] = [len(said[k]) for k in np.flatnonzero(unknown)]
        if at is None:  # plain alignment: the mark put before the text takes none of it
            if text.isascii():
                at = np.arange(len(text) + 1)
            else:
                data = np.frombuffer(text.encode("utf-8"), np.uint8)
                at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
            at = np.concatenate([np.zeros(int(self.prefix), np.int64), at])
        at = np.asarray(at, np.int64)
        done = np.cumsum(takes, dtype=np.int64)
        return ids, at[done - np.where(self.is_byte[own], 1, takes)], at[done]

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(id, first byte, end byte) of each piece."""
        ids, first, end = self.coded(text)
        return list(zip(ids, first.tolist(), end.tolist()))

    def decode(self, ids: list[int]) -> str:
        return self.processor.decode(ids) if ids else ""


_MODELS: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The encoder of a model file, made once in a Python worker."""
    if path not in _MODELS:
        with open(path, "rb") as f:
            _MODELS[path] = Pieces(f.read())
    return _MODELS[path]


def encode(text: Column, path: str) -> Column:
    """array<struct<id, start, end>>: pieces of a text with their byte spans."""

    @F.pandas_udf("array<struct<id:int,start:int,end:int>>")
    def run(texts: pd.Series) -> pd.Series:
        p = pieces(path)
        return pd.Series([[{"id": i, "start": s, "end": e} for i, s, e in p.spans(t)] for t in texts])

    return run(text)


def _sha(s: str) -> str:
    return hashlib.sha256(s.encode("utf-8")).hexdigest()


def spans_digest(first: np.ndarray, end: np.ndarray) -> str:
    """Of the byte spans, written '0-3,3-7'."""
    return _sha(",".join(map("%d-%d".__mod__, zip(first.tolist(), end.tolist()))))


def ids_and_text(text: Column, path: str) -> Column:
    """struct<ids, decoded, spans_sha256>: ids of a text, the text they decode
    to, and the digest of their byte spans."""

    @F.pandas_udf("ids array<int>, decoded string, spans_sha256 string")
    def run(texts: pd.Series) -> pd.DataFrame:
        p = pieces(path)
        out = []
        for t in texts:
            ids, first, end = p.coded(t)
            out.append((np.array(ids, np.int32), p.decode(ids), spans_digest(first, end)))
        return pd.DataFrame(out, columns=["ids", "decoded", "spans_sha256"])

    return run(text)


def encoded(docs: DataFrame, path: str, keep: list[str], most: int = FRAME) -> DataFrame:
    """The columns ``keep`` of every document, n_tokens, ids, decoded_sha256 (of
    the text that the ids decode to) and spans_sha256.  Frames are sent on after
    ``most`` ids, so what a task holds doesn't grow with the texts of a batch."""
    kept = [(f"_{i}", c) for i, c in enumerate(keep)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = pieces(path)
        for part in parts:
            first, size, rows = 0, 0, []
            for i, t in enumerate(part["_text"], 1):
                ids, start, end = p.coded(t)
                rows.append((len(ids), np.array(ids, np.int32), _sha(p.decode(ids)), spans_digest(start, end)))
                size += len(ids)
                if size >= most or i == len(part):
                    out = pd.DataFrame(rows, columns=["n_tokens", "ids", "decoded_sha256", "spans_sha256"], index=part.index[first:i])
                    yield pd.concat([part[[x for x, _ in kept]].iloc[first:i], out], axis=1)
                    first, size, rows = i, 0, []

    rows = docs.select(*(F.col(c).alias(x) for x, c in kept), F.col("text").alias("_text"))
    kinds = "".join(f"{x} {docs.schema[c].dataType.simpleString()}, " for x, c in kept)
    out = rows.mapInPandas(run, f"{kinds}n_tokens long, ids array<int>, decoded_sha256 string, spans_sha256 string")
    return out.select(*(F.col(x).alias(c) for x, c in kept), "n_tokens", "ids", "decoded_sha256", "spans_sha256")


def digest(docs: DataFrame, path: str, spans: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, and with
    ``spans`` spans_sha256; the digests are taken in the task, so no ids leave it."""
    columns = ["n_tokens", "ids_sha256", "decoded_sha256", *["spans_sha256"] * spans]

    @F.pandas_udf(", ".join(f"{c} {'long' if c == 'n_tokens' else 'string'}" for c in columns))
    def run(texts: pd.Series) -> pd.DataFrame:
        p = pieces(path)
        out = []
        for t in texts:
            ids, first, end = p.coded(t)
            row = (len(ids), _sha(",".join([p.decimal[i] for i in ids])), _sha(p.decode(ids)))
            out.append((*row, spans_digest(first, end)) if spans else row)
        return pd.DataFrame(out, columns=columns)

    return docs.select("doc_id", run("text").alias("r")).select("doc_id", "r.*")
