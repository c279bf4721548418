"""Cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes, and how often in the corpus.

A byte-level BPE file (A) and a sentencepiece BPE model (B) both encode a space and the text. Byte offsets where tokens of both end cut them into groups; every A token of a group is linked to
every B token of it.

1. Tasks encode their texts, a slice at a time, and write for each slice one row of documents and for each stripe of A ids (id modulo STRIPES) one row of its pairs: their documents and links.
2. Pairs are dealt by stripe and by a part of the slices. There np.add.at adds their documents into dense matrices of ROWS of the stripe's A ids by all B ids. The parts of a
   stripe are added up alike, and each row's maximum marks the best pairs.
3. Links are dealt by the same stripes and parts, meet the counts there, and are scored from the same matrices; one sum a document leaves a stripe, and these meet by slice.

A slice has at most SLICE_BYTES of text (or one text), a part's stripe at most the rows of PART_SLICES slices, so no group grows with the corpus, and a pair or id in every document is a few bytes of each
slice's row. What is written after step 1 goes to the shared folder, so texts are encoded once.

Neither tokenizer joins letters or marks with a space after them (B's pieces are checked for that), so texts are cut before single spaces between them, and a task encodes each such unit once.

Defined results: texts that are null, empty, or whose tokens' bytes differ from space and text (U+2581 in them, which B reads as a space) have no tokens: zeros and ''. Each row is a document,
so repeated rows and equal or null ids count as several; an empty table gives no rows; texts of any length are encoded whole; ties for the highest count are all best. Only the id and text columns are read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .token_store import byte_letters
from .wordhash import text_slices

STRIPES = 64
#: Rows of a dense matrix.
ROWS = 64
#: Bytes of texts that are aligned at once, and slices whose pairs and links of a stripe meet in one group.
SLICE_BYTES, PART_SLICES = 6 << 20, 512
#: Units that a task remembers.
REMEMBERED = 500_000
#: Single spaces that both tokenizers cut at.
CUT = re.compile(r"(?<=[\w!-~]) (?=[\w!-~])")

_ROWS = "slice long, stripe int, ids array<long>, sizes binary, digests binary, a binary, b binary, n_docs binary, docs binary, links binary"
_COUNTS = "stripe int, a binary, b binary, n_docs binary, best binary"
_SCORES = "slice long, docs binary, best binary, total binary"
_MEASURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
_RESULT = f"doc_id long, {', '.join(f'{m} long' for m in _MEASURES)}, groups_sha256 string"


def _path(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Grown:
    """An array that grows at its end."""

    def __init__(self, kind=np.int64):
        self.n, self.data = 0, np.empty(1024, kind)

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            more = np.empty(max(2 * len(self.data), self.n + len(values)), self.data.dtype)
            more[: self.n] = self.data[: self.n]
            self.data = more
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


class Aligner:
    """Tokens of both tokenizers, met at their common ends, for units of text; units are remembered up to a bound.

    Of each unit: its groups as written, numbers of A ids, B ids, groups and links (all 0 and '' where the tokens' bytes differ from a space and the unit), and where its links are among all.
    """

    def __init__(self, a: str, b: str, bound: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b, self.bound = Tokenizer.from_file(_path(a)), sentencepiece.SentencePieceProcessor(model_file=_path(b)), bound
        self.a.encode_special_tokens = True
        byte_of = {c: i for i, c in enumerate(byte_letters())}
        size = max(self.a.get_vocab().values()) + 1
        self.a_bytes = [bytes(byte_of.get(c, 0) for c in self.a.id_to_token(i) or "") for i in range(size)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces)
        self.size = max(size, len(pieces))
        self.written = [f"{i}{mark}" for mark in ",|;" for i in range(self.size)]
        self.number, self.texts = {}, []
        self.counts, self.first, self.pairs = Grown(), Grown(), Grown()

    def _keep(self, units: list[str]) -> None:
        """Forget all but these units."""
        old = np.array([self.number[u] for u in units], np.int64)
        counts, first = self.counts.data[: self.counts.n].reshape(-1, 4)[old], self.first.data[old]
        pairs = self.pairs.data[_expanded(counts[:, 3], first)]
        self.number, self.texts = {u: i for i, u in enumerate(units)}, [self.texts[k] for k in old.tolist()]
        self.counts, self.first, self.pairs = Grown(), Grown(), Grown()
        self.counts.add(counts.ravel())
        self.first.add(np.cumsum(counts[:, 3]) - counts[:, 3])
        self.pairs.add(pairs)

    def groups(self, unit: str) -> list[tuple[list[int], list[int]]] | None:
        """Groups of A and B ids of a space and the unit; None where the bytes of their tokens differ from that."""
        a, b, whole = self.a.encode(" " + unit, add_special_tokens=False).ids, self.b.encode(unit), b" " + unit.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return None
        (groups_a, groups_b), _ = self._met(*(np.array(x, np.int64) for x in (a, b)))
        return [([a[k] for k in np.flatnonzero(groups_a == g)], [b[k] for k in np.flatnonzero(groups_b == g)]) for g in range(groups_a[-1] + 1)]

    def parts(self, text: str) -> list[str]:
        return CUT.split(text) if self.cuts else [text]

    def _met(self, a: np.ndarray, b: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        """The group of each A and B token of one stretch of bytes, and the ends of the groups: where tokens of both end."""
        ends = [np.cumsum(np.array([len(x) for x in table])[ids]) for table, ids in ((self.a_bytes, a), (self.b_bytes, b))]
        both = np.intersect1d(*ends, assume_unique=True)
        return tuple(np.searchsorted(both, e) for e in ends), both

    def learn(self, units: set[str]) -> None:
        """Align units that aren't known. Of those that are, only these stay once there are more than the bound."""
        new = sorted(units - self.number.keys())
        if len(self.number) + len(new) > self.bound:
            self._keep(sorted(units & self.number.keys()))
        for at in range(0, len(new), 50_000):
            self._learn(new[at : at + 50_000])

    def _learn(self, units: list[str]) -> None:
        ids = [[x.ids for x in self.a.encode_batch([" " + u for u in units], add_special_tokens=False)], self.b.encode(units)]
        wholes = [b" " + u.encode() for u in units]
        sound = np.ones(len(units), bool)
        for side, table in zip(ids, (self.a_bytes, self.b_bytes), strict=True):
            joined = b"".join(map(table.__getitem__, chain.from_iterable(side)))
            if joined != b"".join(wholes):
                sound &= np.array([b"".join(map(table.__getitem__, own)) == whole for own, whole in zip(side, wholes, strict=True)])
        flat, of = [], []
        for side in ids:
            kept = [own if ok else [] for own, ok in zip(side, sound, strict=True)]
            sizes = np.fromiter(map(len, kept), np.int64, len(kept))
            flat.append(np.fromiter(chain.from_iterable(kept), np.int64, int(sizes.sum())))
            of.append(np.repeat(np.arange(len(units)), sizes))
        (a, b), (of_a, of_b) = flat, of
        (group_a, group_b), ends = self._met(a, b)
        n_a, n_b = (np.bincount(g, minlength=len(ends)) for g in (group_a, group_b))
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        unit = of_a[first_a] if len(ends) else of_a
        # the groups as they are written: ids of A, then of B, each with what follows it
        order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
        side, group, written = (np.concatenate(x)[order] for x in ((np.zeros(len(a), np.int64), np.ones(len(b), np.int64)), (group_a, group_b), (a, b)))
        last = np.diff(2 * group + side, append=-1) != 0
        mark = np.where(last, side + 1, 0)
        parts = [self.written[k] for k in (mark * self.size + written).tolist()]
        until = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        tokens = np.cumsum(np.bincount(of_a, minlength=len(units)) + np.bincount(of_b, minlength=len(units)))
        text, stops = "".join(parts), np.concatenate(([0], until))[tokens].tolist()
        texts = [text[i : j - 1] if j > i else "" for i, j in zip([0, *stops], stops, strict=False)]
        # all A tokens of a group with all its B tokens
        n_links = n_a * n_b
        of_link, k = np.repeat(np.arange(len(ends)), n_links), _expanded(n_links, np.zeros(len(ends), np.int64))
        linked = a[first_a[of_link] + k // n_b[of_link]] << 32 | b[first_b[of_link] + k % n_b[of_link]]
        links = np.bincount(unit, n_links, len(units)).astype(np.int64)
        self.first.add(self.pairs.n + np.cumsum(links) - links)
        self.pairs.add(linked)
        sums = [np.bincount(x, minlength=len(units)) for x in (of_a, of_b, unit)]
        self.counts.add(np.stack([*sums, links], axis=1).ravel())
        self.number.update(zip(units, range(len(self.texts), len(self.texts) + len(units)), strict=True))
        self.texts += texts


@cache
def aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


def _expanded(lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each row, `lengths` of them."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - lengths), lengths)


def slice_rows(known: Aligner, texts: list[str | None], ids: list[int | None], number: int) -> list[dict]:
    """The rows of one slice: its documents, and the pairs of each stripe, in order, with documents and links of each."""
    parts = [known.parts(t) if t else [] for t in texts]
    known.learn(set().union(*parts))
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    unit = np.fromiter(map(known.number.__getitem__, chain.from_iterable(parts)), np.int64, int(lengths.sum()))
    del parts
    doc, all_counts = np.repeat(np.arange(len(texts)), lengths), known.counts.data[: known.counts.n].reshape(-1, 4)
    broken = np.zeros(len(texts), bool)
    broken[doc[all_counts[unit, 0] == 0]] = True
    doc, unit = doc[~broken[doc]], unit[~broken[doc]]
    stops = np.cumsum(np.bincount(doc, minlength=len(texts))).tolist()
    each, digests = unit.tolist(), []
    for i, j in zip([0, *stops], stops, strict=False):
        digests.append(sha256(";".join([known.texts[k] for k in each[i:j]]).encode()).digest() if j > i else bytes(32))
    sizes = np.stack([np.bincount(doc, all_counts[unit, k], len(texts)).astype(np.int64) for k in range(4)], axis=1)
    rows = [{"slice": number, "stripe": -1, "ids": ids, "sizes": common.pack(sizes.ravel()), "digests": b"".join(digests)}]
    if not len(unit):
        return rows
    # each distinct unit of a document, with the number of times
    used, each = np.unique(unit, return_inverse=True)
    once, times = np.unique(doc * len(used) + each, return_counts=True)
    doc, unit = np.divmod(once, len(used))
    linked = all_counts[used, 3]
    flat = known.pairs.data[_expanded(linked, known.first.data[used])]
    place = _expanded(linked[unit], (np.cumsum(linked) - linked)[unit])
    # pairs by stripe, then by ids
    pairs, numbered = np.unique((flat >> 32) % STRIPES << 57 | flat, return_inverse=True)
    key = numbered[place] * len(texts) + np.repeat(doc, linked[unit])
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    links = np.add.reduceat(np.repeat(times, linked[unit])[order], first)
    pair, doc = np.divmod(key[first], len(texts))
    n_docs = np.bincount(pair, minlength=len(pairs))
    a, b, stripe = pairs >> 32 & (1 << 25) - 1, pairs & (1 << 32) - 1, pairs >> 57
    ends = np.cumsum(n_docs)
    start = np.flatnonzero(np.diff(stripe, prepend=-1))
    for lo, hi in zip(start.tolist(), [*start[1:].tolist(), len(pairs)], strict=True):
        some = slice(int(ends[lo] - n_docs[lo]), int(ends[hi - 1]))
        rows.append({
            "slice": number, "stripe": int(stripe[lo]), "a": common.pack(a[lo:hi]), "b": common.pack(b[lo:hi]), "n_docs": common.pack(n_docs[lo:hi]),
            "docs": common.pack(doc[some]), "links": common.pack(links[some]),
        })
    return rows


def _align(a: str, b: str):
    schema = pa.schema([
        ("slice", pa.int64()), ("stripe", pa.int32()), ("ids", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("sizes", "digests", "a", "b", "n_docs", "docs", "links"))
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = aligner(a, b), TaskContext.get().partitionId() << 33
        for batch in text_slices(batches, 1, SLICE_BYTES):
            yield pa.RecordBatch.from_pylist(slice_rows(known, batch.column(1).to_pylist(), batch.column(0).to_pylist(), number), schema)
            number += 1

    return run


def _matrices(a: np.ndarray, b: np.ndarray, n: np.ndarray, columns: int) -> Iterator[tuple[int, np.ndarray]]:
    """Dense counts of ROWS of a stripe's A ids by all B ids, with the first row, for those that have any."""
    row = a // STRIPES
    order = np.argsort(row, kind="stable")
    row, b, n = row[order], b[order], n[order]
    for lo in np.unique(row // ROWS).tolist():
        some = slice(*np.searchsorted(row, (lo * ROWS, (lo + 1) * ROWS)))
        dense = np.zeros((ROWS, columns), np.int64)
        np.add.at(dense, (row[some] - lo * ROWS, b[some]), n[some])
        yield lo * ROWS, dense


def _add(columns: int):
    """Counts of a stripe's pairs from those of slices, or of parts."""

    def run(group: pa.Table) -> pa.Table:
        a, b, n = (np.concatenate([common.unpack(x) for x in group.column(c).to_pylist()]) for c in ("a", "b", "n_docs"))
        stripe, found = group.column("stripe")[0].as_py(), []
        for lo, dense in _matrices(a, b, n, columns):
            row, column = np.nonzero(dense)
            count = dense[row, column]
            found.append(((row + lo) * STRIPES + stripe, column, count, count == dense.max(axis=1)[row]))
        a, b, n, best = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table([pa.array([stripe], pa.int32()), *(pa.array([x], pa.binary()) for x in (common.pack(a), common.pack(b), common.pack(n), np.packbits(best).tobytes()))], ["stripe", "a", "b", "n_docs", "best"])

    return run


def _score(columns: int):
    """Links of a part's stripe against the stripe's counts: for each slice, the documents' sums."""

    def run(links: pa.Table, counts: pa.Table) -> pa.Table:
        known = [common.unpack(counts.column(c)[0].as_py()) for c in ("of_a", "of_b", "of_n_docs")]
        rows = links.to_pylist()
        pairs = [(common.unpack(r["a"]), common.unpack(r["b"])) for r in rows]
        count, best = ([np.zeros(len(a), np.int64) for a, _ in pairs] for _ in range(2))
        for lo, dense in _matrices(*known, columns):
            top = dense.max(axis=1)
            for (a, b), n, is_best in zip(pairs, count, best, strict=True):
                some = slice(*np.searchsorted(a // STRIPES, (lo, lo + ROWS)))  # pairs are in the order of A ids
                at = a[some] // STRIPES - lo
                n[some] = dense[at, b[some]]
                is_best[some] = n[some] == top[at]
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for r, n, is_best in zip(rows, count, best, strict=True):
            each, doc, times = common.unpack(r["n_docs"]), common.unpack(r["docs"]), common.unpack(r["links"])
            size = int(doc.max()) + 1
            total = np.zeros((2, size), np.int64)
            np.add.at(total[0], doc, times * np.repeat(is_best, each))
            np.add.at(total[1], doc, times * np.repeat(n, each))
            sums[r["slice"]] = total
        out = []
        for number, total in sums.items():
            some = np.flatnonzero(total[1])
            out.append({"slice": number, "docs": common.pack(some), "best": common.pack(total[0][some]), "total": common.pack(total[1][some])})
        return pa.Table.from_pylist(out, pa.schema([("slice", pa.int64()), *((c, pa.binary()) for c in ("docs", "best", "total"))]))

    return run


def _documents(group: pa.Table) -> pa.Table:
    """The documents of a slice with the sums of all stripes."""
    rows = group.to_pylist()
    (own,) = (r for r in rows if r["ids"] is not None)
    sizes = common.unpack(own["sizes"]).reshape(-1, 4)
    sums = np.zeros((2, len(sizes)), np.int64)
    for r in rows:
        if r["ids"] is None:
            doc = common.unpack(r["docs"])
            sums[0][doc] += common.unpack(r["best"])
            sums[1][doc] += common.unpack(r["total"])
    digests = [own["digests"][32 * i : 32 * i + 32].hex() if n else "" for i, n in enumerate(sizes[:, 0].tolist())]
    columns = [pa.array(own["ids"], pa.int64()), *(pa.array(sizes[:, k]) for k in range(4)), *map(pa.array, sums), pa.array(digests, pa.string())]
    return pa.table(columns, ["doc_id", *_MEASURES, "groups_sha256"])


def _counted(rows: DataFrame, columns: int) -> DataFrame:
    """One row for each stripe: its pairs, their documents, and which are best for their A id."""
    some = rows.where("stripe >= 0").select("stripe", "part", "a", "b", "n_docs")
    return some.groupBy("stripe", "part").applyInArrow(_add(columns), _COUNTS).groupBy("stripe").applyInArrow(_add(columns), _COUNTS)


def _rows(docs: DataFrame, a: str, b: str, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """The slices' rows, in the shared folder, dealt to parts, and the number of these."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = common.checkpoint(source.mapInArrow(_align(a, b), _ROWS))
    parts = max(1, -(-rows.where("stripe < 0").count() // PART_SLICES))
    return rows.withColumn("part", F.pmod(F.xxhash64("slice"), F.lit(parts)).cast("int")), parts


def align(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document."""
    rows, parts = _rows(docs, a, b, id_col, text_col)
    columns = len(aligner(a, b).b_bytes)
    counted = _counted(rows, columns).withColumn("of_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    known = counted.select(F.col("stripe").alias("of_stripe"), "of_part", *(F.col(c).alias(f"of_{c}") for c in ("a", "b", "n_docs")))
    links = rows.where("stripe >= 0").select("stripe", "part", "slice", "a", "b", "n_docs", "docs", "links")
    scores = links.groupBy("stripe", "part").cogroup(known.groupBy("of_stripe", "of_part")).applyInArrow(_score(columns), _SCORES)
    none = F.lit(None).cast("binary")
    own = rows.where("stripe < 0").select("slice", "ids", "sizes", "digests", none.alias("docs"), none.alias("best"), none.alias("total"))
    summed = scores.select("slice", F.lit(None).cast("array<long>").alias("ids"), none.alias("sizes"), none.alias("digests"), "docs", "best", "total")
    return own.unionAll(summed).groupBy("slice").applyInArrow(_documents, _RESULT)


def pair_counts(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, n_docs, best): in how many documents each pair of ids is linked, and whether no other B id of its A id has more."""
    counted = _counted(_rows(docs, a, b, id_col, text_col)[0], len(aligner(a, b).b_bytes))

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = [common.unpack(r[c]) for c in ("a", "b", "n_docs")]
                best = np.unpackbits(np.frombuffer(r["best"], np.uint8), count=len(ids[0])).astype(bool)
                yield pa.RecordBatch.from_arrays([*map(pa.array, ids), pa.array(best)], ["a", "b", "n_docs", "best"])

    return counted.mapInArrow(flat, "a long, b long, n_docs long, best boolean")


def token_groups(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, groups): the alignment itself, an array of (a, b) id lists for each document."""
    kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(a, b)
        for batch in text_slices(batches, 1, SLICE_BYTES):
            found = []
            for text in batch.column(1).to_pylist():
                groups = [known.groups(unit) for unit in known.parts(text)] if text else []
                found.append([] if None in groups else [{"a": x, "b": y} for g in groups for x, y in g])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "groups"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")
