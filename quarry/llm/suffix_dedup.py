"""Suffix-array dedup: byte strings of `width` that start at two places or more of a corpus are removed, found by bucket-pointer refinement.

The suffixes to be sorted are those at which such a string may start; sorted to a depth of `width` bytes, suffixes of one bucket begin a repeated string.

1. Initial buckets are those of q-grams of width / 4 bytes. Of the grams of a window of `width` bytes the one with the least name, leftmost of equals,
   stands for it: equal windows choose equal grams at equal offsets. So the windows of a text fall into runs of one gram each, and only runs meet, by the names
   of their grams and of all their bytes. A run alone in its bucket holds no repeat. A run with a twin, equal in all bytes, is settled: all its windows repeat.
   The others, and one of the twins if their bucket has different runs, stay open.
2. The windows of open runs are refined. Within a block of texts, suffixes in buckets of one go on unsorted; the others are sorted by their bucket pointer
   and the pointer at a later offset, width / 4 first, and the pointers that this yields are used for the next sort, at twice that offset, until all `width` bytes have been compared.
   One window of each bucket, with a mark if it isn't alone, is met with those of other blocks by its name.
3. Starts of repeated windows, packed by shards of documents, meet there, are joined to their texts, merged into maximal intervals and cut out.

What repeats within a block is known there, and one of it goes on, so a string of a third of all documents is shuffled once a block. Of runs in one bucket with different bytes (a passage's edges) a block
deals two by their gram and the others by their bytes, so no task holds all runs of a frequent gram. Texts of any length are cut into overlapping pieces of BLOCK bytes, so
beyond the text itself a task's memory doesn't follow its length.

Grams and windows are told apart by 64-bit Rabin-Karp names; windows also by their bucket, a range of a second name, and settled runs by the names of gram and bytes together. In n windows met in
b buckets, some n**2 / (2**65 * b) false repeats are expected: well below one at 100 TB, as only windows of open runs, about one in twenty of the test tables, are met.

Defined results: a null text has no bytes; texts of fewer than `width` bytes stay whole; repeated rows are repeats of each other and lose all bytes that a
window covers; rows without an id or with equal ids are told apart by their texts; an empty table stays empty. Cuts may fall within a character, so `kept` is binary. Other
columns, of whatever name but those added (n_bytes, n_removed, removed, kept), are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .wordhash import Powers, binary, mixed, text_slices

#: Bytes of texts that are sorted at once; a power of two, so that a place fits in the low bits of a name.
BLOCK = 1 << 19
#: Runs or windows of successive blocks that are dealt together.
HELD = 250_000
#: Bytes of text of a bucket of runs or windows, and of a task's buckets.
BUCKET_BYTES, TASK_BYTES = 32 << 20, 128 << 20
NO_ID = np.iinfo(np.int64).max
#: A run whose windows all repeat; one whose windows are to be refined.
SETTLED, OPEN = 1, 2

_RUNS = "bucket long, names binary, bytes binary, twins binary, ids binary, sums binary, rows binary, at binary, size binary"
_FOUND = "shard long, ids binary, sums binary, rows binary, at binary, size binary, state binary"
_PLACES = "id_ long, sum_ long, at binary, size binary"


def letters(seed: int) -> np.ndarray:
    """A 64-bit number for each byte."""
    return np.array([xxhash.xxh3_64_intdigest(bytes([b]), seed) for b in range(256)], np.uint64)


class Names:
    """Rabin-Karp names of the strings of a block."""

    def __init__(self, data: np.ndarray, table: np.ndarray, powers: Powers):
        up, self.down = powers.upto(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up[:-1], out=self.sums[1:])

    def all(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[:n]) * self.down[:n])

    def at(self, places: np.ndarray, width) -> np.ndarray:
        return mixed((self.sums[places + width] - self.sums[places]) * self.down[places])


def pieces(texts: list[bytes], width: int, most: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Blocks of (text, offset, bytes) that hold each window of `width` bytes of each text once; of at most `most` bytes."""
    block, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text) - width + 1, most - width + 1):
            piece = text[at : at + most]
            if size + len(piece) > most:
                yield block
                block, size = [], 0
            block.append((i, at, piece))
            size += len(piece)
    if block:
        yield block


def block_arrays(block: list[tuple[int, int, bytes]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a block; of all its windows the place, the text, and what to add to a place for that in the text."""
    data = np.frombuffer(b"".join(p for _, _, p in block), np.uint8)
    sizes = np.array([len(p) for _, _, p in block])
    first, counts = np.cumsum(sizes) - sizes, sizes - width + 1
    places = np.arange(counts.sum()) + np.repeat(first - (np.cumsum(counts) - counts), counts)
    return data, places, np.repeat([i for i, _, _ in block], counts), np.repeat(np.array([at for _, at, _ in block]) - first, counts)


def least_grams(names: np.ndarray, grams: int) -> np.ndarray:
    """For each run of `grams` successive names the place of the least one, by all bits but those of a place; of equals the leftmost."""
    low = np.uint64(BLOCK - 1)
    least, width = (names & ~low) | np.arange(len(names), dtype=np.uint64), 1
    while 2 * width <= grams:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    rest = grams - width
    return ((np.minimum(least[: len(least) - rest], least[rest:]) if rest else least) & low).astype(np.int64)


def window_runs(block: list[tuple[int, int, bytes]], width: int, gram: int, table: np.ndarray, powers: Powers) -> tuple[np.ndarray, ...]:
    """Of each run of windows with one gram: the names of the gram and of the run's bytes, its text, first place there and number of windows."""
    data, places, text, shift = block_arrays(block, width)
    names = Names(data, table, powers)
    grams = names.all(gram)
    chosen = least_grams(grams, width - gram + 1)[places]
    first = np.flatnonzero((np.diff(chosen, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0) | (np.diff(shift, prepend=0) != 0))
    size = np.diff(first, append=len(chosen))
    low, gram_at = places[first], chosen[first]
    where = ((gram_at - low) * width + size).astype(np.uint64)
    return grams[gram_at], mixed(names.at(low, size - 1 + width) ^ mixed(where)), text[first], low + shift[first], size


def _documents(ids: np.ndarray, sums: np.ndarray) -> dict:
    """Runs of equal ids and sums."""
    first = np.flatnonzero((np.diff(ids, prepend=~ids[:1]) != 0) | (np.diff(sums, prepend=~sums[:1]) != 0))
    return {"ids": common.pack(ids[first]), "sums": sums[first].tobytes(), "rows": common.pack(np.diff(first, append=len(ids)))}


def _in_buckets(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    first = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    yield from zip(bucket[order[first]].tolist(), np.split(order, first[1:]), strict=True) if len(order) else ()


def _deal(key: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of names; these are mixed again, as those of the least grams are small."""
    return (((mixed(key) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _source(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    return batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False), batch.column(1).fill_null(0).to_numpy(zero_copy_only=False), [t or b"" for t in binary(batch.column(2))]


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.binary()) for f in common.fields(ddl)])


def _held(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[np.ndarray, ...]]:
    """Successive parts joined, HELD entries or more at a time."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= HELD:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _deal_runs(width: int, gram: int, buckets: int):
    schema = _arrow(_RUNS)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        table, powers = letters(0), Powers()
        for batch in text_slices(batches, 2):
            ids, sums, texts = _source(batch)
            for block in pieces(texts, width, BLOCK):
                name, content, text, at, size = window_runs(block, width, gram, table, powers)
                yield ids[text], sums[text], at, size, name, content

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sums, at, size, name, content in _held(parts(batches)):
            order = np.lexsort((content, name))
            new_name = np.diff(name[order], prepend=~name[order[:1]]) != 0
            new = new_name | (np.diff(content[order], prepend=~content[order[:1]]) != 0)
            start = np.flatnonzero(new)
            several = np.diff(start, append=len(order)) > 1
            # of equal runs one goes on; of runs with one gram, two meet those of other blocks by the gram, the others by their bytes
            among = np.arange(len(start)) - np.maximum.accumulate(np.where(new_name[start], np.arange(len(start)), 0))
            stay, rest = order[start], np.sort(order[~new])
            back = np.argsort(stay)
            stay, several, by_bytes = stay[back], several[back], among[back] > 1
            rows = []
            if len(rest):
                rows.append({"bucket": int(_deal(name[rest[:1]], buckets)[0]), **_documents(ids[rest], sums[rest]), "at": common.pack(at[rest]), "size": common.pack(size[rest])})
            for b, some in _in_buckets(np.where(by_bytes, buckets + _deal(content[stay], buckets), _deal(name[stay], buckets))):
                k = stay[some]
                rows.append({
                    "bucket": b, "names": name[k].tobytes(), "bytes": content[k].tobytes(), "twins": np.packbits(several[some]).tobytes(),
                    **_documents(ids[k], sums[k]), "at": common.pack(at[k]), "size": common.pack(size[k]),
                })
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rows = common.unpack(row["rows"])
    return np.repeat(common.unpack(row["ids"]), rows), np.repeat(np.frombuffer(row["sums"], np.int64), rows), common.unpack(row["at"]), common.unpack(row["size"])


def _joined(rows: list[dict]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*map(_unpacked, rows), strict=True))


def _by_shard(ids: np.ndarray, sums: np.ndarray, at: np.ndarray, size: np.ndarray, state: np.ndarray, shards: int) -> Iterator[dict]:
    """By id and text, as many rows may lack an id or share one."""
    for s, some in _in_buckets(((mixed(ids.view(np.uint64) ^ mixed(sums.view(np.uint64))) >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)):
        some = some[np.lexsort((at[some], sums[some], ids[some]))]
        i, k = ids[some], sums[some]
        text = np.cumsum((np.diff(i, prepend=i[:1]) != 0) | (np.diff(k, prepend=k[:1]) != 0))
        first = np.flatnonzero(np.diff(text, prepend=-1))
        yield {
            "shard": s, "ids": common.pack(i[first]), "sums": k[first].tobytes(), "rows": common.pack(np.diff(first, append=len(i))),
            "at": common.pack(at[some]), "size": common.pack(size[some]), "state": state[some].astype(np.uint8).tobytes(),
        }


def _settle(buckets: int, shards: int):
    """Runs of a bucket that repeat or stay open. Runs dealt by their bytes are known to have others of their gram."""
    schema = _arrow(_FOUND)

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        known, met = [r for r in rows if r["names"] is None], [r for r in rows if r["names"] is not None]
        found = [(*_joined(known), np.full(sum(int(common.unpack(r["rows"]).sum()) for r in known), SETTLED))] if known else []
        if met:
            arrays = _joined(met)
            name, content = (np.concatenate([np.frombuffer(r[c], np.uint64) for r in met]) for c in ("names", "bytes"))
            twin = np.concatenate([np.unpackbits(np.frombuffer(r["twins"], np.uint8), count=len(r["names"]) // 8) for r in met]).astype(bool)
            order = np.lexsort((content, name))
            new_name = np.diff(name[order], prepend=~name[order[:1]]) != 0
            new = new_name | (np.diff(content[order], prepend=~content[order[:1]]) != 0)
            start = np.flatnonzero(new)
            sizes = np.diff(start, append=len(order))
            twins = (sizes > 1) | np.logical_or.reduceat(twin[order], start)
            of_name = np.cumsum(new_name[start]) - 1
            mixed_ = (np.bincount(of_name) > 1)[of_name] | (rows[0]["bucket"] >= buckets)
            state = np.repeat(np.where(twins, SETTLED, np.where(mixed_, OPEN, 0)), sizes)
            state[start] |= np.where(mixed_, OPEN, 0)
            some = np.flatnonzero(state)
            found.append((*(x[order[some]] for x in arrays), state[some]))
        out = list(_by_shard(*(np.concatenate(x) for x in zip(*found, strict=True)), shards)) if found else []
        return pa.Table.from_pylist(out, schema)

    return run


def _gather(wanted: int):
    """Of each document of a shard the places of its runs in the wanted state, in order."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        ids, sums, at, size = _joined(rows)
        state = np.concatenate([np.frombuffer(r["state"], np.uint8) for r in rows])
        some = np.flatnonzero(state & wanted)
        some = some[np.lexsort((at[some], sums[some], ids[some]))]
        ids, sums, at, size = ids[some], sums[some], at[some], size[some]
        first = np.flatnonzero((np.diff(ids, prepend=ids[:1]) != 0) | (np.diff(sums, prepend=sums[:1]) != 0) | (np.arange(len(ids)) == 0))
        packed = [pa.array([common.pack(x) for x in np.split(a, first[1:])] if len(first) else [], pa.binary()) for a in (at, size)]
        return pa.table([pa.array(ids[first]), pa.array(sums[first]), *packed], ["id_", "sum_", "at", "size"])

    return run


def refine(names: np.ndarray, starts: np.ndarray, gram: int, width: int) -> np.ndarray:
    """Bucket pointers of the suffixes at `starts`, equal for those whose first `width` bytes are equal. names: of the grams at all places.

    A pointer is the place of a bucket's first suffix in sorted order, so that a part of a bucket gets one within the bucket's range, and those of other buckets stay right.
    """
    order = np.argsort(names)
    first = np.flatnonzero(np.diff(names[order], prepend=~names[order[:1]]) != 0)
    sizes = np.diff(first, append=len(order))
    pointer, alone = np.empty(len(names), np.int64), np.empty(len(names), bool)
    pointer[order], alone[order] = np.repeat(first, sizes), np.repeat(sizes == 1, sizes)
    steps, depth = [], gram
    while depth < width:
        steps.append(min(depth, width - depth))
        depth += steps[-1]
    needed = [starts[~alone[starts]]]
    for step in reversed(steps[1:]):
        needed.append(np.union1d(needed[-1], needed[-1] + step))
    for step, places in zip(steps, reversed(needed), strict=True):
        places = places[~alone[places]]
        key = pointer[places] << 32 | pointer[places + step]
        order = np.argsort(key)
        key, places = key[order], places[order]
        bucket, index = key >> 32, np.arange(len(key))
        part = np.flatnonzero(np.diff(key, prepend=-1))
        sizes = np.diff(part, append=len(key))
        of_bucket = np.maximum.accumulate(np.where(np.diff(bucket, prepend=-1) != 0, index, 0)) if len(key) else index
        pointer[places] = bucket + np.repeat(part, sizes) - of_bucket
        alone[places] = np.repeat(sizes == 1, sizes)
    return pointer[starts]


def open_regions(text: bytes, at: bytes, size: bytes, width: int) -> Iterator[tuple[int, bytes]]:
    """The stretches of a text that open windows cover, with their places."""
    low, pick = np.unique(common.unpack(at), return_index=True)
    count = common.unpack(size)[pick]
    cut = np.flatnonzero(low[1:] != low[:-1] + count[:-1]) + 1
    for a, b in zip(low[np.concatenate(([0], cut))].tolist(), (low + count)[np.concatenate((cut - 1, [len(low) - 1]))].tolist(), strict=True):
        yield a, text[a : b + width - 1]


def _refine_windows(width: int, gram: int, buckets: int):
    schema = _arrow(_RUNS)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        """Windows with the mark of being known to repeat (1), or of having equals in their block (2), by bucket."""
        table, second, powers = letters(0), letters(1), Powers()
        for batch in text_slices(batches, 2):
            ids, sums, texts = _source(batch)
            regions = [(i, a, r) for i, (t, at, size) in enumerate(zip(texts, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)) for a, r in open_regions(t, at, size, width)]
            of, low = (np.array([r[k] for r in regions]) for k in (0, 1))
            for block in pieces([r for _, _, r in regions], width, BLOCK):
                data, places, region, shift = block_arrays(block, width)
                names = Names(data, table, powers)
                pointer = refine(names.all(gram), places, gram, width)
                order = np.argsort(pointer, kind="stable")
                new = np.diff(pointer[order], prepend=-1) != 0
                mark = np.ones(len(places), np.uint8)
                mark[order[new]] = np.where(np.diff(np.flatnonzero(new), append=len(order)) > 1, 2, 0)
                bucket = _deal(Names(data, second, powers).at(places, width), buckets)
                yield ids[of[region]], sums[of[region]], places + shift + low[region], names.at(places, width), bucket, mark

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sums, at, name, bucket, mark in _held(parts(batches)):
            rows, rest, stay = [], np.flatnonzero(mark == 1), np.flatnonzero(mark != 1)
            if len(rest):
                rows.append({"bucket": int(bucket[0]), **_documents(ids[rest], sums[rest]), "at": common.pack(at[rest])})
            for b, some in _in_buckets(bucket[stay]):
                k = stay[some]
                rows.append({"bucket": b, "names": name[k].tobytes(), "twins": np.packbits(mark[k] == 2).tobytes(), **_documents(ids[k], sums[k]), "at": common.pack(at[k])})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _meet(shards: int):
    """Windows of a bucket that aren't alone."""
    schema = _arrow(_FOUND)

    def run(group: pa.Table) -> pa.Table:
        found, met, names, twins = [], [], [], []
        for row in group.to_pylist():
            arrays = _unpacked(row)[:3]
            if row["names"] is None:
                found.append(arrays)
                continue
            met.append(arrays)
            names.append(np.frombuffer(row["names"], np.uint64))
            twins.append(np.unpackbits(np.frombuffer(row["twins"], np.uint8), count=len(names[-1])).astype(bool))
        if met:
            name, twin = np.concatenate(names), np.concatenate(twins)
            order = np.argsort(name)
            start = np.flatnonzero(np.diff(name[order], prepend=~name[order[:1]]) != 0)
            sizes = np.diff(start, append=len(order))
            some = order[np.repeat((sizes > 1) | np.logical_or.reduceat(twin[order], start), sizes)]
            found.append(tuple(np.concatenate(x)[some] for x in zip(*met, strict=True)))
        ids, sums, at = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.Table.from_pylist(list(_by_shard(ids, sums, at, np.ones(len(at), np.int64), np.full(len(at), SETTLED), shards)), schema)

    return run


def spans(at: np.ndarray, size: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal intervals [from, to) of bytes that windows cover: `size` successive ones from each place on."""
    if not len(at):
        return []
    order = np.argsort(at, kind="stable")
    low, high = at[order], np.maximum.accumulate((at + size - 1 + width)[order])
    cut = np.flatnonzero(low[1:] > high[:-1]) + 1
    return list(zip(low[np.concatenate(([0], cut))].tolist(), high[np.concatenate((cut - 1, [len(high) - 1]))].tolist(), strict=True))


def _cut(width: int, place: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, place):
            texts = [t or b"" for t in binary(batch.column(place))]
            gone, kept = [], []
            for text, at, size in zip(texts, *(batch.column(batch.num_columns - k).to_pylist() for k in (2, 1)), strict=True):
                gone.append(spans(common.unpack(at), common.unpack(size), width))
                ends = [0, *(x for span in gone[-1] for x in span), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
            columns = [
                *batch.columns[:-2], pa.array(list(map(len, texts)), pa.int64()), pa.array([len(t) - len(k) for t, k in zip(texts, kept, strict=True)], pa.int64()),
                pa.array([[{"from": a, "to": b} for a, b in g] for g in gone], pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), pa.array(kept, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-2], "n_bytes", "n_removed", "removed", "kept"])

    return run


def _repeated(numbered: DataFrame, width: int, id_col: str, text_col: str, sum_col: str) -> DataFrame:
    spark, gram = numbered.sparkSession, max(1, width // 4)
    own = [F.col(id_col).cast("long").alias("id_"), F.col(sum_col).alias("sum_"), F.col(text_col).cast("string").alias("text_")]
    size = numbered.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    buckets, tasks = (max(common.partitions(spark), -(-size // x)) for x in (BUCKET_BYTES, TASK_BYTES))
    runs = numbered.select(*own).mapInArrow(_deal_runs(width, gram, buckets), _RUNS)
    found = common.checkpoint(runs.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_settle(buckets, buckets), _FOUND))
    names = common.free_names(numbered, "open_id_", "open_sum_", "open_at_", "open_size_")
    still = found.groupBy("shard").applyInArrow(_gather(OPEN), _PLACES).toDF(*names)
    # the same rows are joined again at the end, so Spark shuffles the texts once if they come without other columns
    joined = numbered.join(still, _same(numbered, id_col, sum_col, still)).select(*own, *names[2:])
    windows = joined.mapInArrow(_refine_windows(width, gram, buckets), _RUNS)
    met = windows.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_meet(buckets), _FOUND)
    return found.unionAll(met).groupBy("shard").applyInArrow(_gather(SETTLED), _PLACES)


def _same(numbered: DataFrame, id_col: str, sum_col: str, places: DataFrame) -> F.Column:
    return (F.coalesce(numbered[id_col].cast("long"), F.lit(NO_ID)) == places[places.columns[0]]) & (numbered[sum_col] == places[places.columns[1]])


def repeated_windows(docs: DataFrame, width: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_, sum_, at, size): for each document with repeats, the packed places of runs of windows that also start anywhere else. sum_ is xxhash64 of its text."""
    (sum_col,) = common.free_names(docs, "sum_")
    return _repeated(docs.withColumn(sum_col, F.xxhash64(F.col(text_col).cast("string"))), width, id_col, text_col, sum_col)


def remove_repeats(docs: DataFrame, width: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with n_bytes, n_removed, removed (array of byte intervals) and kept (the bytes that stay)."""
    keyed = docs.drop("n_bytes", "n_removed", "removed", "kept")
    names = common.free_names(keyed, "sum_", "lost_id_", "lost_sum_", "lost_at_", "lost_size_")
    numbered = keyed.withColumn(names[0], F.xxhash64(F.col(text_col).cast("string")))
    lost = _repeated(numbered, width, id_col, text_col, names[0]).toDF(*names[1:])
    joined = numbered.join(lost, _same(numbered, id_col, names[0], lost), "left").drop(*names[:3])
    schema = T.StructType([*keyed.schema.fields, *common.fields("n_bytes long, n_removed long, removed array<struct<from: long, to: long>>, kept binary")])
    return joined.mapInArrow(_cut(width, keyed.columns.index(text_col)), schema)
