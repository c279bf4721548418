"""Quality classifier by co-training (Blum and Mitchell 1998).

Two views of a document, its text and its metadata (source, language, size), get a classifier each. In every round both are fitted, and
each gives the other the unlabelled documents that it is most sure of, with its own verdicts as labels. These are found among all unlabelled documents of the corpus: a Spark job
scores them all with both views, and the surest of all are taken from what the views are sure of. At the end each view is
calibrated (Platt) on labelled documents kept apart, and the two are combined as views that are independent given
the class: the logits add up, less the prior's.

A document is good if its label says quality 1 and not toxic. Text features are hashed words (lower case, outer marks
stripped) and coarse shapes (symbols, capitals, repetition, length); in each fit the words are kept that are associated with the class at a
likelihood ratio of SIGNIFICANT at least. Models are logistic regressions fitted in numpy on the driver.

Bound of the fit: LABELLED labelled documents, the first in the order of a hash of the id, and SHARE of their number from each view and round. All
documents are scored, on their whole texts.

Defined results: a null text is an empty one; null metadata are values of their own; of several labels of a document
the worse counts; a null quality is no label; rows without an id are scored, but not learned from. With no labels, or of one class only, every score is their smoothed share of good
ones. Repeated rows get equal scores, and are learned from once; of equally sure documents those of the smaller hash go first. Columns of the names added are replaced, all others
pass, whatever their name; an empty table stays empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.lineage import remove

from . import common
from .wordhash import binary

#: Most labelled rows that are fitted, and most features of them all: 80 MB on the driver.
LABELLED, FITTED = 20_000, 20_000_000
ROUNDS, SHARE, SURE = 3, 0.1, 0.9
HASHED = 1 << 18
#: Bytes of text whose features a task holds at once, or one text; words whose feature numbers it remembers.
SLICE_BYTES, REMEMBERED = 4 << 20, 150_000
#: Words from which on a text's distinct words and pairs are counted in arrays.
LONG = 20_000
SIGNIFICANT = 25.0
THRESHOLD = 0.5
MARKS = b".,;:!?*$&%#|<>\"'()[]{}=-_"
SYMBOLS, CAPITALS = b"#*$%&|<>!", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Edges of the shape features' cells.
EDGES = {
    "symbols": (0.002, 0.01, 0.03, 0.06, 0.1), "capitals": (0.03, 0.06, 0.1, 0.2, 0.4), "pairs": (0.1, 0.3, 0.5, 0.7, 0.8, 0.9),
    "lines": (0.1, 0.3, 0.5, 0.7, 0.9), "size": (1, 5, 10, 20, 40, 80, 160, 640, 2560),
}
SHAPES = {name: HASHED + 16 * k for k, name in enumerate(EDGES)}
SIZE = HASHED + 16 * len(EDGES)


class WordFeatures(dict):
    """Feature numbers of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        core = word.strip(MARKS)
        value = self[word] = xxhash.xxh3_64_intdigest(core.decode().lower().encode()) % HASHED if core else HASHED - 1
        return value


def text_features(text: bytes, cache: WordFeatures) -> np.ndarray:
    words = text.split()
    n, size = len(words), max(1, len(text))
    numbers = list(map(cache.__getitem__, words))
    if n <= LONG:
        seen, pairs = set(numbers), set(zip(numbers, numbers[1:], strict=False))
    else:  # the same in an array of 8 bytes a word
        packed = np.array(numbers, np.int64)
        seen, pairs = np.unique(packed), np.unique(packed[:-1] * SIZE + packed[1:])
    lines = [x for x in text.split(b"\n") if x.strip()]
    shape = {
        "symbols": 1 - len(text.translate(None, SYMBOLS)) / size, "capitals": 1 - len(text.translate(None, CAPITALS)) / size,
        "pairs": len(pairs) / max(1, n - 1), "lines": len(set(lines)) / max(1, len(lines)), "size": n,
    }
    cells = [SHAPES[name] + sum(shape[name] >= e for e in edges) for name, edges in EDGES.items()]
    return np.array([*seen, *cells], np.int32)


def meta_features(source, lang, n_chars) -> np.ndarray:
    size = "null" if n_chars is None else str(max(0, int(n_chars)).bit_length())
    names = [f"s:{source}", f"l:{lang}", f"n:{size}", f"sl:{source}:{lang}"]
    return np.array([xxhash.xxh3_64_intdigest(x.encode()) % HASHED for x in names], np.int32)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


@dataclass
class View:
    """A sparse logistic regression: feature numbers with weights, calibrated by scale and shift."""

    selective: bool
    features: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    bias: float = 0.0
    scale: float = 1.0
    shift: float = 0.0

    def fit(self, rows: list[np.ndarray], good: np.ndarray) -> None:
        lengths = np.array([len(r) for r in rows])
        flat, row = np.concatenate(rows), np.repeat(np.arange(len(rows), dtype=np.int32), lengths)
        chosen = self._chosen(flat, good[row], good)
        place = np.full(SIZE, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        used = place[flat] >= 0
        column, row = place[flat[used]], row[used]
        n, penalty = len(rows), 1.0
        weights, bias = np.zeros(len(chosen)), float(np.log((good.sum() + 1) / (n - good.sum() + 1)))
        first, second = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
        for step in range(1, 251):
            error = sigmoid(np.bincount(row, weights[column], n) + bias) - good
            gradient = np.append(np.bincount(column, error[row], len(chosen)) + penalty * weights, error.sum()) / n
            first += 0.1 * (gradient - first)
            second += 0.01 * (gradient**2 - second)
            move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
            weights, bias = weights - move[:-1], bias - move[-1]
        self.features, self.weights, self.bias = chosen, weights, bias

    def _chosen(self, flat: np.ndarray, good_of: np.ndarray, good: np.ndarray) -> np.ndarray:
        with_it = np.bincount(flat, minlength=SIZE).astype(float)
        if not self.selective:
            return np.flatnonzero(with_it)
        n, g = len(good), good.sum()
        good_with = np.bincount(flat, good_of, SIZE)
        total = np.zeros(SIZE)
        for seen, expected in (
            (good_with, with_it * g / n), (with_it - good_with, with_it * (n - g) / n),
            (g - good_with, (n - with_it) * g / n), (n - g - with_it + good_with, (n - with_it) * (n - g) / n),
        ):
            total += 2 * seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12))
        return np.flatnonzero((total >= SIGNIFICANT) | ((np.arange(SIZE) >= HASHED) & (with_it > 0)))

    def calibrate(self, rows: list[np.ndarray], good: np.ndarray) -> None:
        """Platt scaling by Newton's method, with his smoothed targets."""
        z = self.raw(rows, self.table())
        g = good.sum()
        target = np.where(good > 0, (g + 1) / (g + 2), 1 / (len(good) - g + 2))
        scale, shift = 1.0, 0.0
        for _ in range(50):
            p = sigmoid(scale * z + shift)
            w = np.maximum(p * (1 - p), 1e-9)
            e = p - target
            h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
            d = np.linalg.solve(h, np.array([(e * z).sum() + 1e-3 * (scale - 1), e.sum()]))
            scale, shift = scale - d[0], shift - d[1]
            if abs(d).max() < 1e-8:
                break
        self.scale, self.shift = float(max(scale, 0.0)), float(shift)

    def table(self) -> np.ndarray:
        table = np.zeros(SIZE)
        table[self.features] = self.weights
        return table

    def raw(self, rows: list[np.ndarray], table: np.ndarray) -> np.ndarray:
        return np.array([table[r].sum() for r in rows]) + self.bias

    def logits(self, rows: list[np.ndarray], table: np.ndarray) -> np.ndarray:
        return np.clip(self.scale * self.raw(rows, table) + self.shift, -30, 30)


@dataclass
class CoTrained:
    text: View
    meta: View
    prior: float  # logit

    @property
    def trained(self) -> bool:
        return len(self.text.features) > 0


@dataclass
class Wanted:
    """What a round asks of the unlabelled documents: for each view, the `bad` and `fine` ones that it is surest of, without those it has given (hashes)."""

    model: CoTrained
    bad: int
    fine: int
    given: tuple[set[int], set[int]]


#: (view that is sure, label, hash, text features, meta features)
Given = tuple[int, float, int, np.ndarray, np.ndarray]


def co_train(text: list[np.ndarray], meta: list[np.ndarray], good: np.ndarray, known: np.ndarray, rounds: int = ROUNDS) -> CoTrained:
    """Co-training on rows in memory. good: labels where known; rows that aren't known are the pool, their indexes their hashes."""
    labelled, pool = np.flatnonzero(known), np.flatnonzero(~known)

    def choose(wanted: Wanted) -> list[Given]:
        out = []
        for k, (view, rows) in enumerate(((wanted.model.text, text), (wanted.model.meta, meta))):
            left = np.array([i for i in pool if int(i) not in wanted.given[k]], np.int64)
            for label, which in surest(view.logits([rows[i] for i in left], view.table()), left, wanted):
                out += [(k, label, int(left[i]), text[left[i]], meta[left[i]]) for i in which]
        return out

    return _rounds([text[i] for i in labelled], [meta[i] for i in labelled], good[labelled], choose if len(pool) else None, rounds)


def surest(logits: np.ndarray, hashes: np.ndarray, wanted: Wanted) -> list[tuple[float, np.ndarray]]:
    """(label, indexes) of the documents that a view is surest of and sure enough, ties to the smaller hash."""
    p = sigmoid(logits)
    bad, fine = np.lexsort((hashes, p))[: wanted.bad], np.lexsort((hashes, -p))[: wanted.fine]
    return [(0.0, bad[p[bad] <= 1 - SURE]), (1.0, fine[p[fine] >= SURE])]


def _rounds(text: list[np.ndarray], meta: list[np.ndarray], good: np.ndarray, choose: Callable[[Wanted], list[Given]] | None, rounds: int) -> CoTrained:
    model = CoTrained(View(True), View(False), 0.0)
    share = (good.sum() + 1) / (len(good) + 2)
    model.prior = float(np.log(share / (1 - share)))
    if len(good) < 10 or good.min() == good.max():
        return model
    every = np.arange(len(good))
    held, fitted = every[every % 5 == 0], every[every % 5 != 0]
    if not len(held) or not len(fitted) or good[held].min() == good[held].max() or good[fitted].min() == good[fitted].max():
        held = fitted = every
    views = (model.text, text), (model.meta, meta)
    given: list[dict[int, tuple[float, np.ndarray]]] = [{}, {}]  # to each view, by the other
    # as many of each class as the labels' shares say
    most = int(SHARE * len(fitted)) + 1
    bad, fine = int(most * (1 - share)) + 1, int(most * share) + 1
    for turn in range(rounds + 1):
        for (view, rows), extra in zip(views, given, strict=True):
            more = [extra[h] for h in sorted(extra)]
            view.fit([*(rows[i] for i in fitted), *(r for _, r in more)], np.concatenate((good[fitted], [label for label, _ in more])))
            view.calibrate([rows[i] for i in held], good[held])
        if turn == rounds or choose is None:
            break
        for k, label, number, t, m in choose(Wanted(model, bad, fine, (set(given[1]), set(given[0])))):
            given[1 - k][number] = label, (m if k == 0 else t)
    return model


def _slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most SLICE_BYTES of text, or one text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(), dtype=np.int64)
        first = 0
        while first < len(ends):
            most = SLICE_BYTES + (ends[first - 1] if first else 0)
            last = max(first + 1, int(np.searchsorted(ends, most, "right")))
            yield batch.slice(first, last - first)
            first = last


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordFeatures()
    for batch in _slices(batches, 2):
        text = [text_features(t or b"", cache).tobytes() for t in binary(batch.column(2))]
        meta = [meta_features(*r).tobytes() for r in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.binary()), pa.array(meta, pa.binary())], ["doc_id", "number", "text", "meta"])


def _numbers(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b, np.int32) for b in column.to_pylist()]


USED = {"text": T.StringType(), "source": T.StringType(), "lang": T.StringType(), "n_chars": T.LongType()}


def _columns() -> list:
    return [F.col(name).cast(kind).alias(name) for name, kind in USED.items()]


def _sure(wanted: Wanted):
    """(view, label, number, p) of the documents that a view is sure of, without those it has given."""
    schema = pa.schema([("view", pa.int32()), ("label", pa.float64()), ("number", pa.int64()), ("p", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views = wanted.model.text, wanted.model.meta
        tables = [v.table() for v in views]
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            rows = _numbers(batch.column(1)), _numbers(batch.column(2))
            for k, view in enumerate(views):
                p = sigmoid(view.logits(rows[k], tables[k]))
                fresh = np.array([n not in wanted.given[k] for n in numbers.tolist()], bool)
                at = np.flatnonzero(fresh & ((p >= SURE) | (p <= 1 - SURE)))
                columns = np.full(len(at), k), (p[at] >= SURE).astype(float), numbers[at], p[at]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return run


def _pool(features: DataFrame, labelled: DataFrame) -> Callable[[Wanted], list[Given]]:
    """The surest of all documents without a label. features: (number, text, meta); labelled: (number).

    Two passes over the features a round, neither of which shuffles them: the first leaves some 24 bytes of each document that a view is sure of, which labelled ones are taken from
    and the surest of which are found; the second lets the few chosen ones through.
    """

    def choose(wanted: Wanted) -> list[Given]:
        sure = features.select("number", "text", "meta").mapInArrow(_sure(wanted), "view int, label double, number long, p double")
        found = common.checkpoint(sure.join(labelled, "number", "left_anti").distinct())
        chosen = []
        for view in (0, 1):
            for label, most, order in ((0.0, wanted.bad, F.asc("p")), (1.0, wanted.fine, F.desc("p"))):
                chosen += found.where((F.col("view") == view) & (F.col("label") == label)).orderBy(order, "number").limit(most).collect()
        if not chosen:
            return []
        spark = features.sparkSession
        numbers = spark.createDataFrame([(n,) for n in {r["number"] for r in chosen}], "number long")  # 2 * (bad + fine) at most
        rows = features.join(F.broadcast(numbers), "number").select("number", "text", "meta").toArrow()
        # texts that share an id share a number: the smallest counts
        of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for number, text, meta in sorted(zip(*(rows.column(c).to_pylist() for c in ("number", "text", "meta")), strict=True)):
            of.setdefault(number, (np.frombuffer(text, np.int32), np.frombuffer(meta, np.int32)))
        return [(r["view"], r["label"], r["number"], *of[r["number"]]) for r in chosen]

    return choose


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, seed: int = 3, fitted: int = FITTED) -> CoTrained:
    """Co-train on at most `labelled` rows with labels, in the order of a hash as far as they have `fitted` features together, and on those of all rows without that the views are sure of.

    Texts are read once: their features, 4 bytes a distinct word, are written to the shared folder, where the rounds read them, and removed at the end.
    """
    number = F.xxhash64(F.col("doc_id").cast("long"), F.lit(seed))
    verdicts = (
        labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.min("quality") == 1).alias("fine"), F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic"))
        .select("doc_id", (F.col("fine") & (F.col("toxic") == 0)).cast("double").alias("good"))
    )
    source = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), number.alias("number"), *_columns())
    ids = source.select("doc_id").distinct()
    first = common.checkpoint(verdicts.join(ids, "doc_id").withColumn("number", number).orderBy("number").limit(labelled))  # `labelled` rows at most
    path = f"{common.shared_dir(docs.sparkSession)}/features-{uuid.uuid4().hex}"
    try:
        source.select("doc_id", "number", *USED).mapInArrow(_featurize, "doc_id long, number long, text binary, meta binary").write.parquet(path)
        features = docs.sparkSession.read.parquet(path)
        known = features.join(F.broadcast(first.select("doc_id", "good")), "doc_id").select("number", "good", "text", "meta")
        # a window over `labelled` ids at most
        size = known.groupBy("number").agg(F.sum(F.octet_length("text") + F.octet_length("meta")).alias("size"))
        upto = F.sum("size").over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, 0))
        few = size.withColumn("upto", upto).where(F.col("upto") <= 4 * fitted).select("number")
        table = known.join(F.broadcast(few), "number").toArrow()
        own = sorted(set(zip(*(table.column(c).to_pylist() for c in table.column_names), strict=True)))  # in one order, repeated rows once
        text, meta = ([np.frombuffer(r[k], np.int32) for r in own] for k in (2, 3))
        return _rounds(text, meta, np.array([r[1] for r in own]), _pool(features, verdicts.select(number.alias("number"))), rounds)
    finally:
        remove(docs.sparkSession, path)


def _score(model: CoTrained, place: list[int], columns: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordFeatures()
        tables = model.text.table(), model.meta.table()
        for batch in _slices(batches, place[0]):
            n = batch.num_rows
            if model.trained:
                text = model.text.logits([text_features(t or b"", cache) for t in binary(batch.column(place[0]))], tables[0])
                meta = model.meta.logits([meta_features(*r) for r in zip(*(batch.column(k).to_pylist() for k in place[1:]), strict=True)], tables[1])
            else:
                text = meta = np.full(n, model.prior)
            score = sigmoid(text + meta - model.prior)
            new = [pa.array(sigmoid(text)), pa.array(sigmoid(meta)), pa.array(score), pa.array(score >= threshold)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:columns], *new], [*batch.schema.names[:columns], "text_score", "meta_score", "score", "kept"])

    return run


def classify(docs: DataFrame, model: CoTrained, threshold: float = THRESHOLD) -> DataFrame:
    """The rows with text_score, meta_score, score (probability of a good document) and kept."""
    docs = docs.drop("text_score", "meta_score", "score", "kept")
    n = len(docs.columns)
    place, cast = [], []
    fed_names = dict(zip(USED, common.free_names(docs, *(f"fed_{name}_" for name in USED)), strict=True))
    for name, kind in USED.items():
        own = [k for k, f in enumerate(docs.schema.fields) if f.name.lower() == name and f.dataType == kind]
        if not own:  # a text is sent once unless it needs a cast
            cast.append(F.col(name).cast(kind).alias(fed_names[name]))
        place.append(own[0] if own else n + len(cast) - 1)
    fed = docs.select("*", *cast)
    schema = T.StructType([*docs.schema.fields, *common.fields("text_score double, meta_score double, score double, kept boolean")])
    return fed.mapInArrow(_score(model, place, n, threshold), schema)
