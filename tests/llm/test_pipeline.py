"""Each stage of the pipeline against brute force on its own input."""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import pytest

import corpus_pipeline
from quarry.llm import common, quality_classifier, source_mixing
from quarry.llm.sentencepiece_codec import codec
from tests.llm.test_sql_operators import brute_dedup, brute_groups, words

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """The rows that go into each stage, and what comes out at the end."""
    docs = common.table(spark, SMALL, "documents")
    found = [docs]
    for _, stage in corpus_pipeline.STAGES:
        found.append(common.checkpoint(stage(spark, found[-1], SMALL)))
    return found


def rows(df):
    return [tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()]


def test_order_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "jaccard_join", "substring_dedup", "source_mixing", "sentencepiece"]
    assert all(s.columns == corpus_pipeline.COLUMNS for s in steps[1:-1])


def test_rejected_documents_go(spark, steps):
    model = quality_classifier.fit(steps[0], common.table(spark, SMALL, "labels"))
    kept = {r["doc_id"] for r in quality_classifier.classify(steps[0], model).where("score >= 0.5").collect()}
    assert sorted(rows(steps[1])) == sorted(r for r in rows(steps[0]) if r[0] in kept)
    labels = {r["doc_id"]: r for r in common.table(spark, SMALL, "labels").collect()}
    clean = {i for i, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0}
    assert len(clean & kept) / len(clean) > 0.97 and len(kept) < len(rows(steps[0]))


def test_one_of_each_group_stays(steps):
    before = rows(steps[1])
    first = {i: root for i, root, *_ in brute_groups([(r[0], r[1]) for r in before])}
    assert sorted(rows(steps[2])) == sorted(r for r in before if first[r[0]] == r[0])


def test_repeated_passages_are_cut(steps):
    before = rows(steps[2])
    expected = {}
    for (i, n, gone, digest), r in zip(brute_dedup([(r[0], r[1]) for r in before], 50), before, strict=True):
        if gone == 0 or gone < n:
            expected[i] = digest if gone else hashlib.sha256(" ".join(words(r[1])).encode()).hexdigest()
    after = rows(steps[3])
    assert {r[0]: hashlib.sha256(" ".join(words(r[1])).encode()).hexdigest() for r in after} == expected
    assert all(r[4] == len(r[1]) for r in after)


def test_sources_are_mixed(steps):
    before, mass = rows(steps[3]), defaultdict(int)
    for r in before:
        mass[r[3]] += len(r[1])
    weight = {s: m**source_mixing.ALPHA for s, m in mass.items()}
    expected = []
    for r in before:
        mean = weight[r[3]] / sum(weight.values()) * sum(mass.values()) / mass[r[3]]
        u = int(hashlib.md5(f"17:{r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        n, total = 0, math.exp(-mean)
        while total <= u:
            n += 1
            total += math.exp(n * math.log(mean) - mean - math.lgamma(n + 1))
        expected += [r] * n
    assert sorted(rows(steps[4])) == sorted(expected)


def test_ids_decode_to_the_texts(steps):
    import numpy as np

    coder = codec("piece_bpe_32k.model")
    texts = {r[0]: r[1] for r in rows(steps[4])}
    out = steps[5].collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r[0] for r in rows(steps[4]))
    assert all(coder.decode(np.array(r["ids"])) == texts[r["doc_id"]] for r in out)


def test_run_is_the_stages_in_turn(spark, steps):
    key = lambda df: sorted((r["doc_id"], r["ids_crc32"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SMALL)) == key(steps[-1])


def test_odd_rows(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    text = " ".join(f"w{i}" for i in range(70))
    odd = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0), (None, text, "en", "a", 5), (4, text, None, "b", None)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    for name, rows_ in (("some", docs), ("none", docs.limit(0))):
        rows_.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.read.parquet(f"{tmp_path}/labels.parquet").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert {r["doc_id"] for r in out.collect()} <= {1, 3, 2, None}


def test_texts_that_share_an_id_both_survive(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    odd = [(7, one, "en", "s", 1), (7, two, "en", "s", 1), (7, two, "en", "s", 1), (9, two + " more", "en", "s", 1), (None, one, "en", "s", 1), (None, "else " + one[:80], "en", "s", 1), (None, None, None, None, None)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(map(repr, rows(corpus_pipeline.drop_near_duplicates(spark, docs, SMALL))))
    first, second = sorted([one, two], key=lambda t: hashlib.md5(f"false{t}".encode()).hexdigest())
    kept = [(7, one), (9, two + " more") if second == two else (7, two), (None, "else " + one[:80]), (None, None)]
    assert [eval(r)[:2] for r in got] == sorted(kept, key=repr)  # noqa: S307


def test_odd_rows_of_every_stage(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    text, extra = " ".join(f"w{i}" for i in range(70)), " ".join(f"x{i}" for i in range(30))
    odd = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0), (None, text, "en", "a", 5), (4, text, None, "b", None), (5, f"{extra} {text}", "en", "a", 9)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    key = lambda some: sorted(some, key=repr)
    assert key(rows(corpus_pipeline.keep_good(spark, docs, str(tmp_path)))) == key(odd)
    single = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert key(rows(single)) == key([odd[0], odd[2], odd[3], odd[6]])
    cut = corpus_pipeline.cut_repeated_passages(spark, single, str(tmp_path))
    assert key(rows(cut)) == key([odd[0], odd[2], odd[3], (5, extra, "en", "a", len(extra))])
    mixed = rows(corpus_pipeline.mix_sources(spark, cut, str(tmp_path)))
    assert {r[0] for r in mixed} <= {1, 3, 5} and set(mixed) <= set(rows(cut))  # the source of a null text only is left out
    coded = corpus_pipeline.encode_pieces(spark, cut, str(tmp_path)).collect()
    assert {r["doc_id"]: r["n_pieces"] == 0 for r in coded} == {1: False, 2: True, 3: True, 5: False}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
