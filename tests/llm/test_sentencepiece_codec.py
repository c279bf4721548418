from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import queries
from quarry.llm.common import table
from quarry.llm.sentencepiece_codec import SPACE, Automaton, Codec, decode, encode

MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def codec():
    return Codec(MODEL, remembered=100)


@pytest.fixture(scope="module")
def pieces():
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))
    return {sp.id_to_piece(i).replace(SPACE, " "): sp.get_score(i) for i in range(259, sp.get_piece_size())}


def best_score(text, pieces, unknown):
    """By trying every piece at every position of the whole text, without parts or automata."""
    best = [0.0]
    for end in range(1, len(text) + 1):
        ways = [best[end - n] + pieces[p] for n in range(1, min(16, end) + 1) if (p := text[end - n : end]) in pieces]
        best.append(max([*ways, *([] if text[end - 1] in pieces else [best[end - 1] + unknown])]))
    return best[-1]


def test_scores_are_the_best(codec, pieces):
    draw = random.Random(3)
    for _ in range(60):
        text = "".join(draw.choice("theraningof  é.,\nñ日▁Z0") for _ in range(60))
        ids = np.frombuffer(codec.encode([text])[0], codec.kind)
        names = [codec.bytes_of[i].decode() if i >= 259 else None for i in ids]
        unknown = sum(codec.unknown for p in codec.parts(" " + text) for c in p if c not in pieces)
        got = sum(pieces[n] for n in names if n) + unknown
        assert got == pytest.approx(best_score(" " + text, pieces, codec.unknown), rel=1e-12)


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_any_text_comes_back(text):
    from quarry.llm.sentencepiece_codec import codec as shared

    c = shared(MODEL)
    text = text.encode("utf-8", "ignore").decode()
    assert c.decode(np.frombuffer(c.encode([text])[0], c.kind)) == text


def test_parts_together_as_alone(codec, monkeypatch):
    monkeypatch.setattr("quarry.llm.sentencepiece_codec.TOGETHER", 20)
    draw = random.Random(9)
    parts = ["".join(draw.choice("theraningof éç,.ñ日▁Z0s") for _ in range(draw.randint(1, 24))) for _ in range(3000)]
    expected = [np.array(codec.segment(p)[0], codec.kind).tobytes() for p in parts]
    assert codec.segment_all(parts) == expected
    assert codec.segment_all([]) == []


def test_output_links_give_every_suffix_piece():
    a = Automaton({p: (i, -1.0) for i, p in enumerate(["she", "he", "e", "hers", "s"])})
    node = 0
    for c in "she":
        node = a.after(node, ord(c))
    assert [n for n, _, _ in a.outputs(node)] == [3, 2, 1]


def test_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x " * 50_000, None), (3, "x " * 50_000, None), (None, "▁ é\t\n", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = decode(encode(docs)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["decoded"] or "") for r in out) == sorted((a or 0, b or "", b or "") for a, b, _ in rows)
    assert [r["n_pieces"] for r in out if r["doc_id"] in (1, 2)] == [0, 0]
    assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in out)
    assert decode(encode(docs.limit(0))).collect() == []


def test_whole_table(spark, codec, pieces):
    small = "/root/testdata/sf0.001"
    out = {r["doc_id"]: r for r in queries.op4_sentencepiece(spark, small).collect()}
    docs = table(spark, small, "documents").collect()
    assert len(out) == len(docs) and all(r["round_trip"] for r in out.values())
    for r in docs[:25]:
        ids, score = [], 0.0
        for p in codec.parts(" " + r["text"]):
            found, s = codec.segment(p)
            ids, score = ids + found, score + s
        assert out[r["doc_id"]]["n_pieces"] == len(ids)
        assert out[r["doc_id"]]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert score == pytest.approx(best_score(" " + r["text"], pieces, codec.unknown), rel=1e-12)
