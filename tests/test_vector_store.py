"""The versioned vector store: rebuild or increment, whole versions only, collisions, compaction."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarry.operators import retrieval
from quarry.plans import sync
from quarry.sources.vectors import Decision, VectorStore


def chunk(docs):
    return retrieval.chunks(docs, 10, 2, "source").withColumnRenamed("doc_id", "source")


def embed(scale, dims=3):
    def run(df):
        calls.append(1)
        return sync.batch_embed(df, lambda texts: [[scale * len(t)] + [0.0] * (dims - 1) for t in texts])

    return run


calls: list[int] = []


def frame(spark, rows):
    return spark.createDataFrame(rows, "source string, text string")


def rows(store, version=None):
    return sorted((r.source, r.chunk, r.total, r.text, list(r.embedding), r.born) for r in store.read(version).collect())


def test_life_of_a_store(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "store"))
    assert store.versions() == [] and store.read().collect() == [] and store.settings() == {}
    first = frame(spark, [("a", "0123456789abcdef"), ("b", "bb"), ("c", None)])
    assert store.sync(first, chunk, embed(1.0), "m1", 3) == Decision("rebuild", "no version")
    one = rows(store)
    assert one == [("a", 1, 2, "0123456789", [10.0, 0.0, 0.0], 1), ("a", 2, 2, "89abcdef", [8.0, 0.0, 0.0], 1), ("b", 1, 1, "bb", [2.0, 0.0, 0.0], 1), ("c", 1, 1, "", [0.0, 0.0, 0.0], 1)]
    assert store.sync(first, chunk, embed(1.0), "m1", 3) == Decision("none", "no change") and store.versions() == [1]
    assert store.decide(first.unionAll(frame(spark, [(None, "lost")])), "m1", 3) == Decision("none", "no change")
    # another signature: all is embedded again
    assert store.sync(first, chunk, embed(2.0), "m2", 3) == Decision("rebuild", "signature m1 to m2")
    assert [r[4][0] for r in rows(store)] == [20.0, 16.0, 4.0, 0.0] and rows(store, 1) == one
    # one changed, one deleted, one new: the others keep their rows
    second = frame(spark, [("a", "0123456789abcdef"), ("b", "bbb"), ("d", "dddd")])
    assert {r.source: r.change for r in store.changes(second).collect()} == {"a": "same", "b": "modified", "c": "deleted", "d": "new"}
    assert store.sync(second, chunk, embed(2.0), "m2", 3) == Decision("incremental", "changed sources")
    three = rows(store)
    assert [(r[0], r[4][0], r[5]) for r in three] == [("a", 20.0, 2), ("a", 16.0, 2), ("b", 6.0, 3), ("d", 8.0, 3)]
    assert store.settings()["chunks"] == 4 and len(store.settings()["segments"]) == 2
    assert [r.text for r in store.where(source="d", chunk=1).collect()] == ["dddd"]
    assert store.sync(second, chunk, embed(1.0, 4), "m2", 4) == Decision("rebuild", "dimension 3 to 4")
    assert store.sync(second, chunk, embed(1.0, 4), "m2", 4, force=True).why == "forced"
    store.compact()
    assert [r[:4] for r in rows(store)] == [r[:4] for r in three] and len(store.settings()["segments"]) == 1
    assert store.sync(second, chunk, embed(1.0, 4), "m2", 4).mode == "none"
    store.drop_before(6)
    assert store.versions() == [6] and [r[:4] for r in rows(store)] == [r[:4] for r in three]


def test_unfinished_versions_are_not_seen(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "store"))
    docs = frame(spark, [("a", "x"), ("b", "y")])
    with pytest.raises(ValueError, match="2 vectors"):
        store.sync(docs, chunk, embed(1.0, 2), "m", 3)
    with pytest.raises(ValueError, match="twice"):
        store.sync(docs.unionAll(docs), chunk, embed(1.0), "m", 3)
    assert store.versions() == [] and store.read().collect() == []
    store.sync(docs, chunk, embed(1.0), "m", 3)
    before = rows(store)
    with pytest.raises(ValueError, match="vectors"):
        store.sync(docs.withColumn("text", F.lit("z")), chunk, embed(1.0, 2), "m", 3)
    assert rows(store) == before and store.versions() == [1]
    with pytest.raises(Exception, match="exist"):  # another writer finished this version first
        store._finish(1, {})
    assert store.settings()["signature"] == "m"
    store.sync(frame(spark, []), chunk, embed(1.0), "m", 3)
    assert store.read().collect() == [] and store.decide(docs, "m", 3) == Decision("rebuild", "empty")
