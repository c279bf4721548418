"""Source divergence audit: how far the term frequencies of a language's sources lie apart, by sort-based streaming.

1. Each task reduces its documents, a block at a time, to partial runs (lang, term, source, first document, documents, occurrences). These are dealt by (lang, term) and sorted within their
   partition by (lang, term, source, document).
2. A scan adds up runs of one source, then of one term, holds one term's sources at a time, and passes on terms in at least `least` documents of the language with their counts by source.
3. Those counts are dealt by language and a part of its terms and meet the totals of all sources of the language. Each such group yields partial sums for pairs of sources and its own best terms of each source;
   sums and the best of these are the result.

With c occurrences in a group, N of all V kept terms there, p = 1 + floor(SCALE * (c + PRIOR) / (N + PRIOR * V)), in integers; where a product could pass 64 bits, in Python's.

Terms are runs of ASCII letters and of characters from U+0080 on, with only A to Z in lower case. Defined results: null lang, source and text are read as ''; each row is a document, so repeated rows
and equal ids count as several (no id is read); a group without terms has pairs, with the values that counts of 0 give, and no terms; a language of one source has no pairs, one without kept terms
pairs of value 0; an empty table gives no rows. Texts of any length are read in pieces that end between terms, and ties are ranked by the item's UTF-8 bytes. Only lang, source and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .wordhash import binary

SCALE, PRIOR = 1_000_000_000, 5
#: Terms of the documents that a task reduces at once, and bytes of a text that are read at once.
BLOCK_TERMS, PIECE = 2_000_000, 4 << 20
#: Rows that a task hands on at once.
BATCH = 100_000
#: Terms of a group of the last step, and cells of a matrix of its terms by sources.
GROUP_TERMS, CELLS = 20_000, 2_000_000
#: Sources that are compared with all others at once.
STRIPE = 256
#: Bytes of terms, in lower case; others end a term.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_PARTIAL = "lang string, term string, source string, doc long, n_docs long, n long"
_RUNS = "lang string, term string, sources array<string>, counts array<long>"
_PARTS = "lang string, source string, part string, item string, value long"


class Numbers(dict):
    """Successive numbers for new keys."""

    def __missing__(self, key) -> int:
        self[key] = found = len(self)
        return found


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of those of at most PIECE bytes (or of one term)."""
    at = 0
    while at < len(text):
        end = at + PIECE
        piece = text[at:end].translate(LETTERS)
        if end < len(text) and piece[-1:] != b" " and text[end : end + 1].translate(LETTERS) != b" ":
            cut = piece.rfind(b" ")
            if cut < 0:  # a term of more than a piece
                rest = text[end:].translate(LETTERS)
                cut = rest.find(b" ")
                piece += rest if cut < 0 else rest[:cut]
            else:
                piece = piece[:cut]
        yield piece.split()
        at += max(len(piece), 1)


class Block:
    """Documents of a task, counted together."""

    def __init__(self):
        self.known, self.groups, self.ids, self.weights, self.sizes, self.of, self.docs = Numbers(), Numbers(), [], [], [], [], []
        self.total = 0

    def add(self, group: tuple[str, str], doc: int, text: bytes) -> None:
        ids, weights = [], []
        for words in terms(text):
            found = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            each = np.ones(len(found), np.int64)
            if len(text) > PIECE:
                found, each = np.unique(found, return_counts=True)
            ids.append(found)
            weights.append(each)
        self.ids += ids
        self.weights += weights
        self.sizes.append(sum(map(len, ids)))
        self.of.append(self.groups[group])
        self.docs.append(doc)
        self.total += self.sizes[-1]

    def partial_runs(self) -> Iterator[pa.RecordBatch]:
        """One row for each group and term, in order; and one with the term '' for each group."""
        if not self.docs:
            return
        doc, of = np.repeat(np.arange(len(self.docs)), self.sizes), np.array(self.of)
        term, weight = np.concatenate([np.empty(0, np.int64), *self.ids]), np.concatenate([np.empty(0, np.int64), *self.weights])
        key = (of[doc] * len(self.known) + term) * len(self.docs) + doc
        order = np.argsort(key)
        key = key[order]
        pair = key // len(self.docs)
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        docs = np.add.reduceat(np.diff(key, prepend=-1) != 0, first, dtype=np.int64) if len(first) else first
        count = np.add.reduceat(weight[order], first) if len(first) else first
        group, word = np.divmod(pair[first], max(len(self.known), 1))
        marks = np.arange(len(self.groups))
        lead = np.concatenate((np.unique(of, return_index=True)[1], doc[order][first]))
        group, word = np.concatenate((marks, group)), np.concatenate((np.full(len(marks), len(self.known)), word))
        docs, count = np.concatenate((np.bincount(of), docs)), np.concatenate((np.zeros(len(marks), np.int64), count))
        langs, sources = (pa.array([g[k] for g in self.groups], pa.string()) for k in (0, 1))
        words, numbers = pa.array([*self.known, b""], pa.binary()).cast(pa.string()), np.array(self.docs)
        for a in range(0, len(group), BATCH):
            s = slice(a, a + BATCH)
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(group[s])), words.take(pa.array(word[s])), sources.take(pa.array(group[s])), *(pa.array(x, pa.int64()) for x in (numbers[lead[s]], docs[s], count[s]))],
                ["lang", "term", "source", "doc", "n_docs", "n"],
            )


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block, doc = Block(), TaskContext.get().partitionId() << 33
    for batch in batches:
        langs, sources = (batch.column(k).to_pylist() for k in (0, 1))
        for lang, source, text in zip(langs, sources, binary(batch.column(2)), strict=True):
            block.add((lang or "", source or ""), doc, text or b"")
            doc += 1
            if block.total >= BLOCK_TERMS:
                yield from block.partial_runs()
                block = Block()
    yield from block.partial_runs()


def _changes(*columns: pa.Array) -> np.ndarray:
    """Where a row differs from the one before it; the first does."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    out[:1] = True
    for c in columns:
        out[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return out


def _scan(least: int):
    """Sorted partial runs to terms in at least `least` documents, with their counts by source. The term '' passes with all sources of its language."""

    def runs(table: pa.Table) -> pa.Table:
        """A row for each lang, term and source."""
        lang, term, source = (table.column(c).combine_chunks() for c in ("lang", "term", "source"))
        first = np.flatnonzero(_changes(lang, term, source))
        sums = [np.add.reduceat(table.column(c).to_numpy(), first) for c in ("n_docs", "n")]
        return pa.table([*(c.take(pa.array(first)) for c in (lang, term, source)), *map(pa.array, sums)], ["lang", "term", "source", "n_docs", "n"])

    def kept(table: pa.Table) -> pa.RecordBatch:
        lang, term = (table.column(c).combine_chunks() for c in ("lang", "term"))
        first = np.flatnonzero(_changes(lang, term))
        sizes = np.diff(first, append=len(lang))
        stay = np.add.reduceat(table.column("n_docs").to_numpy(), first) >= least
        stay |= pc.equal(term.take(pa.array(first)), "").to_numpy(zero_copy_only=False)
        rows, at = pa.array(np.flatnonzero(np.repeat(stay, sizes))), pa.array(first[stay])
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes[stay]))), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, table.column(c).combine_chunks().take(rows)) for c in ("source", "n")]
        return pa.RecordBatch.from_arrays([lang.take(at), term.take(at), *lists], ["lang", "term", "sources", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = runs(pa.Table.from_batches([batch]).select(["lang", "term", "source", "n_docs", "n"]))
            if rest is not None:
                table = runs(pa.concat_tables([rest, table]))
            lang, term = (table.column(c).combine_chunks() for c in ("lang", "term"))
            last = int(np.flatnonzero(_changes(lang, term))[-1])
            if last:
                yield kept(table.slice(0, last))
            rest = table.slice(last)
        if rest is not None:
            yield kept(rest)

    return run


def shares(counts: np.ndarray, totals: np.ndarray, prior: int, scale: int) -> np.ndarray:
    """1 + floor(scale * (count + prior) / total), exactly."""
    if counts.size and int(counts.max()) + prior > (2**63 - 1) // scale:
        counts, totals = counts.astype(object), totals.astype(object)
    return (1 + scale * (counts + prior) // totals).astype(np.int64)


def _compare(prior: int, scale: int, top: int):
    """Partial sums of the differences of all pairs of sources over a part of a language's terms, and the best of these terms for each source."""

    def run(key: tuple, counted: pa.Table, totals: pa.Table) -> pa.Table:
        lang, rows = key[0].as_py(), {"source": [], "part": [], "item": [], "value": []}
        sources = totals.column("source").to_pylist()
        order = sorted(range(len(sources)), key=lambda i: sources[i].encode())
        sources = [sources[i] for i in order]
        own, kept = totals.column("n").to_numpy()[order], int(totals.column("v")[0].as_py())
        per_group, of_lang = own + prior * kept, np.array([int(own.sum()) + prior * kept])
        counted = counted.take(pc.sort_indices(pc.cast(counted.column("term"), pa.binary())))
        lists, words = counted.column("sources").combine_chunks(), counted.column("term").to_pylist()
        row = np.repeat(np.arange(len(words)), np.diff(lists.offsets.to_numpy()))
        column = pc.index_in(lists.flatten(), pa.array(sources)).to_numpy(zero_copy_only=False).astype(np.int64)
        count = counted.column("counts").combine_chunks().flatten().to_numpy()

        def blocks() -> Iterator[tuple[int, np.ndarray]]:
            step = max(1, CELLS // max(len(sources), 1))
            for a in range(0, len(words), step):
                dense, some = np.zeros((min(step, len(words) - a), len(sources)), np.int64), slice(*np.searchsorted(row, (a, a + step)))
                dense[row[some] - a, column[some]] = count[some]
                yield a, dense

        for a in range(0, len(sources), STRIPE):
            sums = np.zeros((min(STRIPE, len(sources) - a), len(sources)), np.int64)
            for _, dense in blocks():
                p = shares(dense, per_group, prior, scale)
                for i in range(len(sums)):
                    sums[i] += np.abs(p - p[:, a + i : a + i + 1]).sum(axis=0)
            for i, values in enumerate(sums.tolist()):
                others = [j for j in range(len(sources)) if j != a + i]
                rows["source"] += [sources[a + i]] * len(others)
                rows["part"] += ["pair"] * len(others)
                rows["item"] += [sources[j] for j in others]
                rows["value"] += [values[j] for j in others]
        best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(sources)
        for a, dense in blocks():
            over = shares(dense, per_group, prior, scale) - shares(dense.sum(axis=1, keepdims=True), of_lang, prior, scale)
            for j in range(len(sources)):
                some = np.flatnonzero((dense[:, j] > 0) & (over[:, j] > 0))
                place, value = np.concatenate((best[j][0], some + a)), np.concatenate((best[j][1], over[some, j]))
                first = np.argsort(-value, kind="stable")[:top]
                best[j] = place[first], value[first]
        for source, (place, value) in zip(sources, best, strict=True):
            rows["source"] += [source] * len(place)
            rows["part"] += ["term"] * len(place)
            rows["item"] += [words[k] for k in place.tolist()]
            rows["value"] += value.tolist()
        return pa.table([pa.array([lang] * len(rows["value"]), pa.string()), *(pa.array(rows[c], pa.string()) for c in ("source", "part", "item")), pa.array(rows["value"], pa.int64())], _PARTS.replace(" string", "").replace(" long", "").split(", "))

    return run


def term_counts(docs: DataFrame, least: int = 30) -> DataFrame:
    """(lang, term, sources, counts) of the kept terms, and with the term '' all sources of each language."""
    spark = docs.sparkSession
    partial = docs.select("lang", "source", F.col("text").cast("string").alias("text")).mapInArrow(_reduce, _PARTIAL)
    dealt = partial.repartition(common.partitions(spark), "lang", "term").sortWithinPartitions("lang", "term", "source", "doc")
    return dealt.mapInArrow(_scan(least), _RUNS)


def audit(docs: DataFrame, least: int = 30, prior: int = PRIOR, scale: int = SCALE, top: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank): each source's distances to the others of its language, and its `top` terms above the language's own shares."""
    counted = common.checkpoint(term_counts(docs, least))
    terms_of = counted.where("term <> ''")
    sizes = terms_of.groupBy("lang").agg(F.count("*").alias("v"))
    parts = max(1, -(-terms_of.count() // GROUP_TERMS))
    own = terms_of.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("n"))
    groups = counted.where("term = ''").select("lang", F.explode("sources").alias("source"))
    totals = groups.join(own, ["lang", "source"], "left").join(sizes, "lang", "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"))
    each = totals.withColumn("of_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumnRenamed("lang", "of_lang")
    of_terms = terms_of.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"))
    found = of_terms.groupBy("lang", "part").cogroup(each.groupBy("of_lang", "of_part")).applyInArrow(_compare(prior, scale, top), _PARTS)
    # a term is in one group, so its sum is its value
    summed = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return summed.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))
