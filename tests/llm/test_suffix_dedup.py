"""Suffix-array dedup against brute force, and its defined cases."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import suffix_dedup
from quarry.llm.wordhash import Powers


def brute(texts, width):
    """Per text: its maximal removed intervals, straight from the definition."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + width] for t in data for i in range(len(t) - width + 1))
    out = []
    for t in data:
        gone = sorted({k for i in range(len(t) - width + 1) if seen[t[i : i + width]] > 1 for k in range(i, i + width)})
        cuts = [k for k in gone if k - 1 not in set(gone)], [k + 1 for k in gone if k + 1 not in set(gone)]
        out.append(list(zip(*cuts, strict=True)))
    return out


def expected(rows, width):
    out = []
    for (key, text), gone in zip(rows, brute([t for _, t in rows], width), strict=True):
        t = (text or "").encode()
        lost = {k for a, b in gone for k in range(a, b)}
        out.append((key, len(t), len(lost), gone, bytes(c for i, c in enumerate(t) if i not in lost)))
    return sorted(out, key=repr)


def found(docs, width):
    out = suffix_dedup.remove_repeats(docs, width=width)
    return sorted(((r[0], r.n_bytes, r.n_removed, [(s["from"], s["to"]) for s in r.removed], bytes(r.kept)) for r in out.collect()), key=repr)


def corpus(draw, n, letters):
    passages = ["".join(draw.choice(letters) for _ in range(draw.randint(5, 120))) for _ in range(6)]
    rows = []
    for i in range(n):
        text = "".join(draw.choice(passages) if draw.random() < 0.5 else "".join(draw.choice("äö" + letters) for _ in range(draw.randint(1, 40))) for _ in range(draw.randint(0, 6)))
        rows.append((draw.choice([None, i, i, i, i // 2]), text if draw.random() < 0.95 else None))
    return rows + rows[:5]


@pytest.mark.parametrize(("width", "letters", "seed"), [(5, "abcdefgh", 1), (20, "ab", 2), (24, "abcdefghijklmnop", 3), (1, "abcdefghijklmnopq", 4)])
def test_by_brute_force(spark, width, letters, seed):
    rows = corpus(random.Random(seed), 80, letters)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(docs, width) == expected(rows, width)


def test_small_blocks(spark, monkeypatch):
    """Texts longer than a block are cut into pieces, and runs of one gram are met by their bytes."""
    draw = random.Random(9)
    passage = "".join(draw.choice("abcdefgh") for _ in range(70))
    rows = [(i, "".join(draw.choice("abcdefgh") for _ in range(draw.randint(0, 30))) + passage + "".join(draw.choice("abcdefgh") for _ in range(draw.randint(0, 30)))) for i in range(60)]
    rows += [(100, passage * 40), (101, "x" * 3000), (102, "y" * 15), (103, "")]
    monkeypatch.setattr(suffix_dedup, "BLOCK", 256)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    batches = docs.select("doc_id", F.xxhash64("text"), "text").toArrow().to_batches()
    assert sum(b.num_rows for b in suffix_dedup._deal_runs(16, 4, 3)(batches)) > 0
    blocks = list(suffix_dedup.pieces([t.encode() for _, t in rows], 16, 256))
    assert max(sum(len(p) for _, _, p in b) for b in blocks) <= 256
    windows = Counter((i, at + k) for b in blocks for i, at, p in b for k in range(len(p) - 15))
    assert windows == Counter((i, k) for i, (_, t) in enumerate(rows) for k in range(len(t) - 15))
    assert found(docs, 16) == expected(rows, 16)


def test_refine_sorts_by_all_bytes():
    """Pointers are equal just where the first `width` bytes are, whatever subset of places is asked for."""
    draw = np.random.default_rng(3)
    for width, gram in ((7, 1), (8, 2), (200, 50), (13, 3)):
        data = draw.integers(0, 2, 900).astype(np.uint8)
        data[300:600] = data[:300]
        names = suffix_dedup.Names(data, suffix_dedup.letters(0), Powers()).all(gram)
        starts = np.sort(draw.choice(len(data) - width + 1, 400, replace=False))
        pointer = suffix_dedup.refine(names, starts, gram, width).tolist()
        strings = [data[s : s + width].tobytes() for s in starts]
        assert len(set(pointer)) == len(set(strings)) == len(set(zip(pointer, strings, strict=True)))


def test_defined_cases(spark):
    rows = [(1, "", "a", 1), (None, "abcdefghij", "b", 2), (2, None, "c", 3), (3, "abcdefgh--", "d", 4), (4, "zz", None, 5), (4, "zz", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed string, lost_id_ int")
    out = suffix_dedup.remove_repeats(docs, width=8)
    assert out.columns == ["doc_id", "text", "lost_id_", "n_bytes", "n_removed", "removed", "kept"]
    got = sorted((r.doc_id or 0, r.lost_id_, r.n_bytes, r.n_removed, bytes(r.kept)) for r in out.collect())
    assert got == [(0, 2, 10, 8, b"ij"), (1, 1, 0, 0, b""), (2, 3, 0, 0, b""), (3, 4, 10, 8, b"--"), (4, 5, 2, 0, b"zz"), (4, 5, 2, 0, b"zz")]
    empty = suffix_dedup.remove_repeats(docs.limit(0))
    assert empty.collect() == []
