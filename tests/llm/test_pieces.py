from __future__ import annotations

import hashlib

import pyarrow.parquet as pq
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from llm_data import SF001
from polytext.llm import pieces as P
from polytext.llm.queries import tokenizer

ODD = ["", " ", "   a  ", "Hello  world\n é 😀 ﬁ ①", "▁x ▁▁", "\x00a", "a" * 3000, "<0x0A> <s> </s> <unk>", "日本語 テキスト\r\n\t.", "é Å ｆｕｌｌ　ｗ ①②  x ", "𐍈 \u200b\ufeff"]


def texts():
    return pq.read_table(f"{SF001}/documents.parquet", columns=["text"])["text"].to_pylist()


def test_ids_and_decoding_match_the_library():
    p, lib = P.pieces(tokenizer()), sentencepiece.SentencePieceProcessor(model_file=tokenizer())
    all_texts = texts() + ODD
    assert p.ids(all_texts) == lib.encode(all_texts)
    assert [p.decode(i) for i in p.ids(all_texts)] == [lib.decode(i) if i else "" for i in lib.encode(all_texts)]
    assert p.ids([None]) == [[]]


def test_spans_cover_the_bytes_of_the_text():
    p, lib = P.pieces(tokenizer()), sentencepiece.SentencePieceProcessor(model_file=tokenizer())
    for t in texts()[:40] + ODD:
        spans, raw = p.spans(t), t.encode()
        assert [s[0] for s in spans] == p.ids([t])[0]
        assert not spans or (spans[0][1], spans[-1][2]) == (0, len(raw))
        assert all(a[2] == b[1] or (a[1:] == b[1:] and a[0] in p.byte) for a, b in zip(spans, spans[1:]))
        said = [(x.id, x.begin, x.end) for x in lib.encode(t, return_type="proto").pieces]
        assert [s for s in spans if s[0] not in p.byte] == [s for s in said if s[0] not in p.byte]


def test_compiled_map_matches_the_library_normaliser():
    n = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", remove_extra_whitespaces=True)
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(n.serialized_model_proto())
    spec = proto.normalizer_spec
    p = P.Pieces.__new__(P.Pieces)
    p.map, p.prefix, p.squeeze = P.CharMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces
    assert p.map.units
    mark = lambda s: s.replace(" ", P.MARK)
    for t in ["Hello  world", " ﬁ ① ｆｕｌｌ　ｗ  ", "é Å e\u0301", "x\u200by", "ｶﾞ", "a\tb\r\nc", "½ ㍿"]:
        norm, at = p.normalise(t)
        assert mark(norm) == mark(n.normalize(t))
        assert len(at) == len(norm) + 1 and at == sorted(at) and at[-1] <= len(t.encode())


def test_columns(spark, odd_docs, no_docs):
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in odd_docs.collect():
        ids = lib.encode(r["text"] or "")
        want.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids) if ids else "")))
    assert sorted(map(tuple, P.digest(odd_docs, tokenizer()).collect()), key=str) == sorted(want, key=str)
    assert P.digest(no_docs, tokenizer()).collect() == []
    row = odd_docs.where("doc_id = 8").select(P.encode(odd_docs["text"], tokenizer()).alias("p"), P.ids_and_text(odd_docs["text"], tokenizer()).alias("t")).first()
    assert [x["id"] for x in row["p"]] == row["t"]["ids"] and row["t"]["decoded"] == "two words"
