"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

A window of `width` words that also starts in a document with a smaller id is a repeat; the words
that repeats cover are removed, as maximal intervals. Three Spark stages do it:

1. Each task hashes the windows of its texts in numpy. A window that occurs in several texts of the
   same block stays once, for the smallest id; the rest is known to be repeated. A task remembers such windows
   (up to FREQUENT of them), so a passage of a third of all documents reaches the shuffle a few times a task, not once a document.
2. Hashes meet by bucket, about 16 MB of text each, whatever the corpus size, in tasks of about TASK_BYTES of text. There,
   positions whose hash has a smaller id elsewhere are found.
3. Positions, packed by shards of documents, meet there, are joined to their documents, merged into maximal intervals and cut out.

Windows are told apart by a 64-bit hash and by their bucket, a range of a second hash of another base, so by more bits the larger the corpus is: of n
windows of a corpus of b buckets some n**2 / (2**65 * b) are expected to be taken for repeats falsely, or about one in 100 TB. (Within one
task's block of 400,000 words the first hash decides alone, which adds a tenth of that.)

Defined results: a null or empty text has no words and comes back with no removal; a text of fewer
than `width` words is kept whole; of equal ids neither is smaller, so a repeated row loses nothing to
its twin; rows with a null id count as larger than every id; an empty table stays empty; a text of more than a block's
words is a block of its own, hashed whole. Other columns, of whatever name but
those added (n_words, n_removed, removed, kept), are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .wordhash import SECOND_BASE, Powers, WordHashes, blocks, hashes_at, mixed, window_places, word_hashes

#: Bytes of text of a bucket and of a task's buckets.
BUCKET_BYTES, TASK_BYTES = 16 << 20, 128 << 20
#: Repeated windows that a task remembers, with the smallest id that each was met at.
FREQUENT = 200_000
NO_ID = np.iinfo(np.int64).max

_PACKED = "bucket long, hashes binary, ids binary, sums binary, runs binary, at binary"
_REPEATS = "shard long, ids binary, sums binary, runs binary, at binary"


def _packed(bucket: int, hashes: np.ndarray | None, text: np.ndarray, position: np.ndarray, ids: np.ndarray, sums: np.ndarray) -> dict:
    """One row: hashes (None: known repeats) with runs of texts and positions in them."""
    first = np.flatnonzero(np.diff(text, prepend=-1))
    of = text[first]
    return {
        "bucket": bucket, "hashes": None if hashes is None else hashes.tobytes(), "ids": common.pack(ids[of]), "sums": sums[of].tobytes(),
        "runs": common.pack(np.diff(first, append=len(text))), "at": common.pack(position),
    }


class Frequent:
    """Hashes of windows that repeated within a block, with the smallest id so far: a bound on memory, not on results.

    Once there are more than `bound`, those of the latest block stay.
    """

    def __init__(self, bound: int = FREQUENT):
        self.bound = bound
        self.hashes, self.least = np.empty(0, np.uint64), np.empty(0, np.int64)

    def lower(self, hashes: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smaller of `least` and what is remembered, which this updates, for sorted distinct hashes."""
        if not len(self.hashes):
            return least
        at = np.minimum(np.searchsorted(hashes, self.hashes), len(hashes) - 1)
        known = hashes[at] == self.hashes
        out = least.copy()
        out[at[known]] = self.least[known] = np.minimum(out[at[known]], self.least[known])
        return out

    def add(self, hashes: np.ndarray, least: np.ndarray) -> None:
        """Remember sorted distinct hashes, with ids that lower() has seen to."""
        if not len(hashes):
            return
        others = hashes[np.minimum(np.searchsorted(hashes, self.hashes), len(hashes) - 1)] != self.hashes
        if others.sum() + len(hashes) > self.bound:
            self.hashes, self.least = hashes[: self.bound], least[: self.bound]
            return
        both = np.concatenate((self.hashes[others], hashes))
        order = np.argsort(both, kind="stable")
        self.hashes, self.least = both[order], np.concatenate((self.least[others], least))[order]


def _hash_windows(width: int, buckets: int, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, powers, second, frequent = WordHashes(), Powers(), Powers(SECOND_BASE), Frequent()
        schema = pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c in ("hashes", "ids", "sums", "runs", "at"))])
        for batch, words in blocks(batches, text_col):
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            sums = batch.column(2).fill_null(0).to_numpy(zero_copy_only=False)
            lengths = np.array([len(w) if len(w) >= width else 0 for w in words])
            flat = np.concatenate([word_hashes(w, cache) for w in words if len(w) >= width] or [np.empty(0, np.uint64)])
            text, position, place = window_places(np.cumsum(lengths), width)
            if not len(text):
                continue
            hashes = hashes_at(flat, place, width, powers)
            rows = []
            order = np.argsort(hashes)
            ordered = hashes[order]
            group = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
            sizes = np.diff(group, append=len(order))
            least = frequent.lower(ordered[group], np.minimum.reduceat(ids[text[order]], group))
            lost = np.zeros(len(hashes), bool)
            lost[order] = ids[text[order]] > np.repeat(least, sizes)
            frequent.add(ordered[group][sizes > 1], least[sizes > 1])
            if lost.any():
                where = np.flatnonzero(lost)
                rows.append(_packed(int(hashes[where[0]] % np.uint64(buckets)), None, text[where], position[where], ids, sums))
            stay = np.flatnonzero(~lost)
            bucket = ((hashes_at(mixed(flat), place[stay], width, second) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            by = np.argsort(bucket.astype(np.uint16 if buckets < 65536 else np.uint32), kind="stable")
            cuts = np.searchsorted(bucket[by], np.arange(buckets + 1, dtype=np.uint64))
            stay = stay[by]
            for b in np.flatnonzero(np.diff(cuts)):
                part = stay[cuts[b] : cuts[b + 1]]
                rows.append(_packed(int(b), hashes[part], text[part], position[part], ids, sums))
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    runs = common.unpack(row["runs"])
    return np.repeat(common.unpack(row["ids"]), runs), np.repeat(np.frombuffer(row["sums"], np.int64), runs), common.unpack(row["at"])


def _by_text(ids: np.ndarray, sums: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by text and position, with the first index of each text."""
    order = np.lexsort((at, sums, ids))
    ids, sums, at = ids[order], sums[order], at[order]
    return ids, sums, at, np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (sums[1:] != sums[:-1]))))


def _find_repeats(shards: int):
    """Positions of one bucket whose hash has a smaller id elsewhere, packed by shards of documents."""
    schema = pa.schema([("shard", pa.int64()), *((c, pa.binary()) for c in ("ids", "sums", "runs", "at"))])

    def run(group: pa.Table) -> pa.Table:
        hashes, parts, lost = [], [], []
        for row in group.to_pylist():
            if row["hashes"] is None:
                lost.append(_unpacked(row))
            else:
                hashes.append(np.frombuffer(row["hashes"], np.uint64))
                parts.append(_unpacked(row))
        if hashes:
            values = np.concatenate(hashes)
            ids, sums, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            del parts
            order = np.argsort(values)
            values = values[order]
            first = np.concatenate(([True], values[1:] != values[:-1]))
            several = ~(first & np.concatenate((first[1:], [True])))
            order, start = order[several], np.flatnonzero(first[several])
            if len(order):
                least = np.minimum.reduceat(ids[order], start)
                order = order[ids[order] > np.repeat(least, np.diff(start, append=len(order)))]
                lost.append((ids[order], sums[order], at[order]))
        rows = []
        if sum(len(x[0]) for x in lost):
            ids, sums, at = (np.concatenate(x) for x in zip(*lost, strict=True))
            # by id and text, as many rows may lack an id or share one
            shard = (mixed(ids.view(np.uint64) ^ mixed(sums.view(np.uint64))) >> np.uint64(33)) % np.uint64(shards)
            for s in np.unique(shard):
                some = shard == s
                i, k, p, start = _by_text(ids[some], sums[some], at[some])
                rows.append({"shard": int(s), "ids": common.pack(i[start]), "sums": k[start].tobytes(), "runs": common.pack(np.diff(start, append=len(i))), "at": common.pack(p)})
        return pa.Table.from_pylist(rows, schema)

    return run


def _gather(group: pa.Table) -> pa.Table:
    """All repeated positions of each document of a shard."""
    ids, sums, at, start = _by_text(*(np.concatenate(x) for x in zip(*map(_unpacked, group.to_pylist()), strict=True)))
    starts = [common.pack(p) for p in np.split(at, start[1:])]
    return pa.table([pa.array(ids[start]), pa.array(sums[start]), pa.array(starts, pa.binary())], ["id_", "sum_", "starts"])


def intervals(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal intervals [from, to) of words that windows at `starts` cover."""
    s = np.unique(starts)
    if not len(s):
        return []
    cut = np.flatnonzero(np.diff(s) > width)
    return [(int(a), int(b) + width) for a, b in zip(s[np.concatenate(([0], cut + 1))], s[np.concatenate((cut, [len(s) - 1]))], strict=True)]


def _cut(width: int, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in blocks(batches, text_col):
            starts = batch.column(batch.num_columns - 1).to_pylist()
            n_removed, spans, kept = [], [], []
            for w, found in zip(words, starts, strict=True):
                gone = intervals(common.unpack(found), width) if found else []
                left, last = [], 0
                for a, b in gone:
                    left += w[last:a]
                    last = b
                left += w[last:]
                n_removed.append(len(w) - len(left))
                spans.append([{"from": a, "to": b} for a, b in gone])
                kept.append(b" ".join(left))
            columns = [
                *batch.columns[:-1], pa.array(list(map(len, words)), pa.int64()), pa.array(n_removed, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), pa.array(kept, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "n_words", "n_removed", "removed", "kept"])

    return run


def repeated_starts(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_, sum_, starts): for each document with repeats, the packed starts of its repeated windows."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id_"), F.col(text_col).cast("string").alias("text_"))
    size = source.agg(F.sum(F.octet_length("text_"))).first()[0] or 0
    buckets = max(common.partitions(spark), -(-size // BUCKET_BYTES))
    hashed = source.withColumn("sum_", F.xxhash64("text_")).mapInArrow(_hash_windows(width, buckets, "id_", "text_"), _PACKED)
    tasks = max(common.partitions(spark), -(-size // TASK_BYTES))
    lost = hashed.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_find_repeats(buckets), _REPEATS)
    return lost.groupBy("shard").applyInArrow(_gather, "id_ long, sum_ long, starts binary")


def remove_repeats(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with n_words, n_removed, removed (array of word intervals) and kept (the words that stay, joined by a space)."""
    keyed = docs.drop("n_words", "n_removed", "removed", "kept")
    names = common.free_names(keyed, "lost_id_", "lost_sum_", "lost_starts_")
    lost = repeated_starts(docs, width, id_col, text_col).toDF(*names)
    same = (F.coalesce(keyed[id_col].cast("long"), F.lit(NO_ID)) == lost[names[0]]) & (F.xxhash64(keyed[text_col].cast("string")) == lost[names[1]])
    joined = keyed.join(lost, same, "left").drop(*names[:2])
    schema = T.StructType([*keyed.schema.fields, *common.fields("n_words long, n_removed long, removed array<struct<from: long, to: long>>, kept string")])
    return joined.mapInArrow(_cut(width, text_col), schema)
