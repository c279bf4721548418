from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import queries, token_store
from quarry.llm.common import table

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def coder():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def brute(rows, coder):
    """By the contract, one document at a time."""
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_matches_brute_force_on_a_whole_table(spark, coder):
    rows = [tuple(r) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    got = queries.op10_token_store(spark, SMALL)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == brute(rows, coder)


def test_round_trip_with_odd_texts(spark, coder):
    passage = "the same passage again and again, " * 80
    rows = [
        (4, None, "x"), (2, "", "x"), (11, "twin twin", "x"), (11, "twin twin", "x"), (None, "no id", "x"), (9, "ÉCOLE école ﬁ É <|endoftext|> don't 123abc   a\u0085b", None), (1, passage + "one", "x"),
        (7, passage + "two", "x"), (8, "word " * 30_000, "x"), (3, "İstanbul ΣΑΣ ... --- ''' I'LL they've", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    path = token_store.new_path(spark)
    token_store.write_store(docs, path)
    pairs = [(a, b) for a, b, _ in rows]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(map(tuple, token_store.verify_store(spark, path).collect()), key=key) == brute(pairs, coder)
    got = {r["doc_id"]: r["ids"] for r in token_store.read_store(spark, path).collect()}
    assert got == {a: [*coder.encode(b or "", add_special_tokens=False).ids, 1] for a, b in pairs}
    # the shared passage is stored once
    chunks = spark.read.parquet(f"{path}/rows/kind=chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    assert chunks.agg({"n": "sum"}).first()[0] < sum(map(len, got.values()))


def test_words_encode_like_whole_texts(coder):
    known = token_store.UnitIds("word_bpe_49k.json", bound=50)
    draw = random.Random(1)
    every = "abcXYZéÉßñ.,!*$&%#|'’\"-_0129<>|Σİ́­中文×"
    few = "abcXYZéÉßñÇŁł.,!*$&%#|\"-_0129>\x1c\x00"
    for n in range(400):
        letters = every if n % 2 else few
        text = " ".join("".join(draw.choice(letters) for _ in range(draw.randint(1, 9))) for _ in range(20))
        got = np.frombuffer(known.encode([text.encode()])[0], known.kind).tolist()
        assert token_store.plain(text.encode()) or n % 2
        assert got == coder.encode(text, add_special_tokens=False).ids


def test_every_latin_letter(coder):
    known = token_store.UnitIds("word_bpe_49k.json")
    for c in range(0xC0, 0x250):
        for text in (f"a{chr(c)}b, {chr(c)}.", f"{chr(c)}{chr(c)}!?"):
            assert np.frombuffer(known.encode([text.encode()])[0], known.kind).tolist() == coder.encode(text, add_special_tokens=False).ids, hex(c)


def test_damage_is_found(spark):
    docs = spark.createDataFrame([(i, f"some text number {i} " * 90) for i in range(20)], "doc_id long, text string")
    path = token_store.new_path(spark)
    token_store.write_store(docs, path)
    chunks = spark.read.parquet(f"{path}/rows/kind=chunks")
    worse = chunks.selectExpr("digest", "n", "overlay(ids PLACING X'FFFF' FROM 1) AS ids", "doc_id").collect()
    spark.createDataFrame([tuple(r) for r in worse], "digest binary, n long, ids binary, doc_id long").write.mode("overwrite").parquet(f"{path}/rows/kind=chunks")
    with pytest.raises(Exception, match="has other content"):
        token_store.verify_store(spark, path).collect()


def test_an_empty_table(spark):
    path = token_store.new_path(spark)
    token_store.write_store(spark.createDataFrame([], "doc_id long, text string"), path)
    assert token_store.verify_store(spark, path).collect() == []


def test_joined_checksums():
    ids = np.arange(1000, dtype="<u4")
    parts = [ids[:1], ids[1:400], ids[400:]]
    assert token_store.crc_joined([(len(p), zlib.crc32(p.tobytes())) for p in parts]) == zlib.crc32(ids.tobytes())


def test_another_vocabulary_is_given_whole_texts(spark):
    name = "byte_bpe_50k.json"
    other = Tokenizer.from_file(public_tokenizers.path(name))
    rows = [(1, "Hello World 2024 foo"), (2, "two  spaces\n\nand lines, don't"), (3, None), (4, "ÉCOLE ﬁ 中文")]
    path = token_store.new_path(spark)
    token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string"), path, name)
    assert sorted(map(tuple, token_store.verify_store(spark, path, name).collect())) == brute(rows, other)
    assert {r["doc_id"]: r["ids"] for r in token_store.read_store(spark, path, name).collect()} == {i: [*other.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    assert token_store.UnitIds("word_bpe_49k.json").by_word and not token_store.UnitIds(name).by_word


def test_manifest_has_levels(spark, monkeypatch, coder):
    monkeypatch.setattr(token_store, "PART_ROWS", 4)
    monkeypatch.setattr(token_store, "HOT", 5)  # 'same' is looked up apart
    rows = [(None if i % 3 == 0 else i // 2, "same" if i % 2 else f"text {i}") for i in range(70)]
    path = token_store.new_path(spark)
    token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), path)
    stored = spark.read.parquet(f"{path}/manifest").orderBy("level", "part").collect()
    assert [sum(r["level"] == k for r in stored) for k in range(5)] == [18, 5, 2, 1, 0]
    recipes = spark.read.parquet(f"{path}/recipes").orderBy("seq").collect()
    assert [r["seq"] for r in recipes] == list(range(70)) and [r["start"] for r in recipes] == [sum(x["n_tokens"] for x in recipes[:i]) for i in range(70)]
    roots = [bytes(r["root"]) for r in recipes]
    while len(roots) > 1:
        roots = [token_store.merkle(roots[i : i + 4]) for i in range(0, len(roots), 4)]
    assert bytes(stored[-1]["root"]) == roots[0] and stored[-1]["documents"] == 70
    assert sorted(r["n_tokens"] for r in token_store.verify_store(spark, path).collect()) == sorted(len(coder.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)
    # a changed recipe is found
    spark.createDataFrame([r.asDict() | ({} if r["seq"] else {"n_tokens": 99}) for r in recipes], spark.read.parquet(f"{path}/recipes").schema).write.mode("overwrite").parquet(f"{path}/recipes")
    with pytest.raises(ValueError, match="differs from the manifest"):
        token_store.verify_store(spark, path).collect()
