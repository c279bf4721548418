"""Cross-tokenizer alignment against whole texts given to both libraries, and its defined cases."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import common, queries, token_alignment

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def coders():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def letter_bytes():
    """The byte-level letters, as the decoder has them."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, more = {}, 0
    for b in range(256):
        letters[chr(b) if b in visible else chr(256 + more)] = b
        more += b not in visible
    return letters


def brute_groups(coders, text):
    """Groups of a whole text's tokens, by the offsets where both end."""
    if not text:
        return []
    a, b = coders
    letters = letter_bytes()
    whole = (" " + text).encode()
    left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
    if b"".join(x for _, x in left) != whole or b"".join(x for _, x in right) != whole:
        return []
    ends = [set(np.cumsum([len(x) for _, x in side]).tolist()) for side in (left, right)]
    common_ends, groups = sorted(ends[0] & ends[1]), []
    for start, end in zip([0, *common_ends], common_ends, strict=False):
        group = []
        for side in (left, right):
            at, ids = 0, []
            for i, x in side:
                if start <= at < end:
                    ids.append(i)
                at += len(x)
            group.append(ids)
        groups.append(tuple(group))
    return groups


def brute(coders, rows):
    groups = [brute_groups(coders, text) for _, text in rows]
    links = [[(x, y) for left, right in g for x in left for y in right] for g in groups]
    held = Counter(p for each in links for p in set(each))
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for (key, _), g, each in zip(rows, groups, links, strict=True):
        digest = hashlib.sha256(";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g).encode()).hexdigest() if g else ""
        out.append((key, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(each), sum(held[p] == top[p[0]] for p in each), sum(held[p] for p in each), digest))
    return sorted(out, key=repr)


def strange(draw, n):
    bits = ["the", "cat", "Übergröße", "naïve", "<|endoftext|>", "<s>", "</s>", "don't", "we'll", "'s", "3.14", "12345", "日本語", "▁", " ", "　", "\n\n", "\t", "  ", "   x", "é", "😀", "\x00", "\x1c", "_", "<0x0A>", "<unk>", "---", "a" * 30]
    return [" ".join(draw.choice(bits) for _ in range(draw.randint(0, 12))) if draw.random() < 0.7 else "".join(draw.choice([*bits, " "]) for _ in range(draw.randint(0, 12))) for _ in range(n)]


def aligned(spark, rows):
    docs = spark.createDataFrame([(*r, "own", 1) for r in rows], "doc_id long, text string, slice string, part int").repartition(4)
    return sorted(map(tuple, token_alignment.align(docs).collect()), key=repr)


def test_by_brute_force(spark, coders):
    draw = random.Random(4)
    rows = [(draw.choice([None, i, i, i // 2]), t) for i, t in enumerate(strange(draw, 300))]
    rows += [*rows[:10], (1000, None), (1001, ""), (1002, "plain words, and then some more words; " * 300), (1003, "x" * 5000)]
    assert aligned(spark, rows) == brute(coders, rows)


def test_whole_table(spark, coders):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op13_token_alignment(spark, SMALL).collect()), key=repr) == brute(coders, rows)


def test_counts_and_groups(spark, coders):
    texts = ["the cat sat", "the cat", "café au lait", "the", None, "broken ▁"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = {r.doc_id: [(g.a, g.b) for g in r.groups] for r in token_alignment.token_groups(docs).collect()}
    assert groups == {i: brute_groups(coders, t) for i, t in enumerate(texts)}
    held = Counter(p for g in groups.values() for p in {(x, y) for left, right in g for x in left for y in right})
    got = {(r.a, r.b): (r.n_docs, r.best) for r in token_alignment.pair_counts(docs).collect()}
    assert got == {p: (n, n == max(m for (x, _), m in held.items() if x == p[0])) for p, n in held.items()}


def test_parts_and_blocks(coders):
    """Counts of parts add up as those of the whole do, whatever the rows of a matrix; small bounds on remembered units change nothing."""
    draw = random.Random(8)
    texts = [t or None for t in strange(draw, 60)]
    small = token_alignment.Aligner("byte_bpe_50k.json", "piece_bpe_32k.model", bound=5)
    whole = token_alignment.slice_rows(token_alignment.aligner("byte_bpe_50k.json", "piece_bpe_32k.model"), texts, list(range(60)), 7)
    assert token_alignment.slice_rows(small, texts, list(range(60)), 7) == whole
    stripe = next(r for r in whole if len(common.unpack(r.get("a"))) > 3)
    a, b, n = (common.unpack(stripe[c]) for c in ("a", "b", "n_docs"))
    assert (a % token_alignment.STRIPES == stripe["stripe"]).all()
    rows = pa.Table.from_pylist([{"stripe": stripe["stripe"], "a": common.pack(a[k:]), "b": common.pack(b[k:]), "n_docs": common.pack(n[k:])} for k in (0, 1, 2)])
    (out,) = token_alignment._add(32000)(rows).to_pylist()
    want = Counter()
    for k in (0, 1, 2):
        want.update(dict(zip(zip(a[k:].tolist(), b[k:].tolist(), strict=True), n[k:].tolist(), strict=True)))
    got = dict(zip(zip(common.unpack(out["a"]).tolist(), common.unpack(out["b"]).tolist(), strict=True), common.unpack(out["n_docs"]).tolist(), strict=True))
    assert got == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.align(docs).collect() == []
    assert token_alignment.align(docs.withColumn("n_a", F.lit(1))).columns[:2] == ["doc_id", "n_a"]
