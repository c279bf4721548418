"""Recursive splits and paragraph packs against plain versions on strings, sizes and overlaps."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from quarry.operators import splitting
from quarry.tables import table

SMALL = "/root/testdata/sf0.001"


def plain(text, size, overlap, separators):
    """The recursion on lists of strings, straight from its description."""
    separator = next(s for s in separators if s == "" or s in text)
    rest = separators[separators.index(separator) + 1 :]
    if separator:
        parts = [p for p in re.split(f"(?={re.escape(separator)})", text) if p]
        # separators don't overlap: of two that do the first counts
        fixed = []
        for p in text.split(separator):
            fixed.append(p if not fixed else separator + p)
        parts = [p for p in fixed if p]
    else:
        parts = list(text)
    out, short = [], []

    def flush():
        held = []
        for p in short:
            if sum(map(len, held)) + len(p) > size and held:
                out.append("".join(held))
                while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(p) > size):
                    held.pop(0)
            held.append(p)
        if held:
            out.append("".join(held))
        short.clear()

    for p in parts:
        if len(p) < size:
            short.append(p)
        else:
            flush()
            out.extend(plain(p, size, overlap, rest) if rest else [p])
    flush()
    return out


def some_text(draw):
    bits = ["word", "a", "longer-word-than-most", ". ", " ", " ", "\n", "\n\n", "\n\n\n", "x" * 45, "é", "…"]
    return "".join(draw.choice(bits) for _ in range(draw.randint(0, 120)))


def test_split_by_brute_force():
    draw = random.Random(1)
    for _ in range(400):
        text, size = some_text(draw), draw.choice([5, 12, 30, 60])
        overlap = draw.randint(0, size // 2)
        want = [p.strip() for p in plain(text, size, overlap, splitting.SEPARATORS)] if len(text) > size else [text]
        got = [text[a:b] for a, b in splitting.chunks_of(text, size, overlap)]
        assert got == [p for p in want if p], (text, size, overlap)
        assert all(len(p) <= size for p in got)


def test_every_word_is_in_a_chunk():
    draw = random.Random(2)
    for _ in range(100):
        text = some_text(draw)
        covered = {k for a, b in splitting.chunks_of(text, 30, 8) for k in range(a, b)}
        assert all(k in covered for k, c in enumerate(text) if not c.isspace())


def test_rows(spark):
    docs = spark.createDataFrame([(1, "one two three four", "N"), (2, None, "N"), (3, "", "N"), (4, "short", "N"), (5, "A: b c d e f g h", None)], "doc_id long, text string, name string")
    out = splitting.split(docs, 10, 3, F.concat(F.lit("["), "name", F.lit("] ")), "A:")
    assert out.columns == ["doc_id", "name", "chunk", "total", "start", "chunk_text"]
    rows = sorted(map(tuple, out.collect()), key=lambda r: (r[0], r[2]))
    assert [r[:1] + r[2:] for r in rows] == [
        (1, 0, 3, 0, "[N] one two"), (1, 1, 3, 8, "[N] three"), (1, 2, 3, 14, "[N] four"), (4, 0, 1, 0, "short"), (5, 0, 2, 0, "A: b c d e"), (5, 1, 2, 9, "e f g h"),
    ]


def test_packs(spark):
    long = "y" * 95
    text = "one\n\ntwo\n\n\n  three is longer  \n\n" + long + "\n\nlast"
    assert splitting.paragraphs_of(text, 20) == ["one\n\ntwo", "three is longer", "y" * 20, "y" * 20, "y" * 20, "y" * 35, "last"]
    assert splitting.paragraphs_of(None, 20) == splitting.paragraphs_of(" \n\n ", 20) == []
    rows = splitting.pack(spark.createDataFrame([(7, text), (8, None)], "id long, text string"), 20).collect()
    assert [(r.id, r.chunk, r.total, r.chunk_text) for r in rows] == [(7, k, 7, p) for k, p in enumerate(splitting.paragraphs_of(text, 20))]


def test_whole_table(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    rows = splitting.split(docs, 600, 80).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for doc, text in texts.items():
        own = sorted((r.chunk, r.start, r.chunk_text) for r in rows if r.doc_id == doc)
        want = [p.strip() for p in plain(text, 600, 80, splitting.SEPARATORS)] if len(text) > 600 else [text]
        assert [t for _, _, t in own] == [p for p in want if p]
        assert all(text[s : s + len(t)] == t for _, s, t in own)
