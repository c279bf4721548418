"""Language identification by a byte-level convolutional network, trained in numpy.

Texts are cut into windows of WINDOW bytes (overlapping, so that every filter position of the whole text is seen). Filters of
several widths slide over a window: as the input is one of 256 bytes at each place, a filter is a table per offset and its response a
sum of looked-up rows. Each filter's largest response in the window, through a rectifier, feeds a softmax over the
languages. A text's probabilities are the means over its windows.

The training sample is bounded by PER_LANGUAGE documents of each language and
WINDOWS_EACH windows of each, and by nothing else, so that no language is lost; some are cut short, so that short texts are learned too. A language's documents are
the first in the order of a hash of id and text, without repeated rows: only hashes below a threshold, set from the language's (approximate) number
of documents so that it lets some SPARE times as many through, are ranked. Training sees text and language
only; prediction sees text only.

Defined results: `und` with score 0 for a null text, one without any letter, or if there is nothing to learn from; repeated rows get equal predictions and are learned from
once; of equally likely languages the first by name; an empty table stays empty; texts of any length are cut into windows whole, AT_ONCE of which are
scored together. The driver holds the sample: PER_LANGUAGE * WINDOWS_EACH windows of WINDOW bytes, 1 MB a language. Columns lang_pred and score are replaced, all others pass, whatever their name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WINDOW, WIDTHS, FILTERS = 128, (2, 3, 4), 16
PER_LANGUAGE, WINDOWS_EACH, SPARE = 2000, 4, 1.5
EPOCHS, BATCH, RATE = 4, 128, 0.01
AT_ONCE = 256


def has_letter(text: str) -> bool:
    """Whether a character of Unicode's categories L is there; numbers such as ² or ½ aren't letters."""
    return any(map(str.isalpha, text))


def windows_of(text: bytes) -> np.ndarray:
    """All windows of a text as rows of bytes, padded with zeros."""
    stride = WINDOW - max(WIDTHS) + 1
    n = max(1, -(-(len(text) - max(WIDTHS) + 1) // stride))
    padded = np.zeros((n - 1) * stride + WINDOW, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::stride]


@dataclass
class Network:
    languages: list[str]
    #: per width: a table (width, 256, FILTERS) and a bias
    tables: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def new(cls, languages: list[str], seed: int) -> Network:
        draw = np.random.default_rng(seed)
        tables = [draw.normal(0, 0.3 / w**0.5, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        return cls(languages, tables, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], draw.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Rectified maxima (windows, filters) and where each maximum is."""
        values, places = [], []
        for table, bias in zip(self.tables, self.biases, strict=True):
            width = len(table)
            response = table[0][windows[:, : WINDOW - width + 1]]
            for j in range(1, width):
                response += table[j][windows[:, j : WINDOW - width + 1 + j]]
            values.append(response.max(axis=1) + bias)
            places.append(response)
        return np.maximum(np.concatenate(values, axis=1), 0), places

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = []
        for at in range(0, len(windows), AT_ONCE):
            z = self.pooled(windows[at : at + AT_ONCE])[0] @ self.out + self.out_bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            parts.append(e / e.sum(axis=1, keepdims=True))
        return np.concatenate(parts)

    def train(self, windows: np.ndarray, answers: np.ndarray, seed: int) -> None:
        """Adam on the cross-entropy; a maximum passes its gradient to the bytes under it."""
        draw = np.random.default_rng(seed)
        values = [*self.tables, *self.biases, self.out, self.out_bias]
        first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
        step = 0
        for _ in range(EPOCHS):
            order = draw.permutation(len(windows))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                x, y = windows[rows], answers[rows]
                hidden, responses = self.pooled(x)
                z = hidden @ self.out + self.out_bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(y)), y] -= 1
                p /= len(y)
                back = (p @ self.out.T) * (hidden > 0)
                gradients = []
                for k, (table, response) in enumerate(zip(self.tables, responses, strict=True)):
                    place = response.argmax(axis=1)
                    own = back[:, k * FILTERS : (k + 1) * FILTERS]
                    g = np.zeros_like(table)
                    for j in range(len(table)):
                        seen = np.take_along_axis(x, place + j, axis=1)
                        np.add.at(g[j], (seen, np.broadcast_to(np.arange(FILTERS), seen.shape)), own)
                    gradients.append(g)
                gradients += [back[:, k * FILTERS : (k + 1) * FILTERS].sum(axis=0) for k in range(len(WIDTHS))]
                gradients += [hidden.T @ p, p.sum(axis=0)]
                step += 1
                for v, g, m, s in zip(values, gradients, first, second, strict=True):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    v -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)


def _sample(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for number, text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                draw = np.random.default_rng((seed, number & 0xFFFFFFFF))
                found = windows_of(text.encode().lower())
                for k, i in enumerate(draw.choice(len(found), min(WINDOWS_EACH, len(found)), replace=False)):
                    w = found[i].copy()
                    if k == 1 or len(found) == 1:
                        w[draw.integers(8, WINDOW) :] = 0
                    rows.append((lang, w.tobytes()))
            columns = zip(*rows, strict=True) if rows else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.binary()), strict=True)], ["lang", "window"])

    return run


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", seed: int = 5) -> Network | None:
    """A network from rows with a known language; None if there are none."""
    text = F.col(text_col).cast("string")
    known = labelled.select(F.xxhash64(F.col(id_col).cast("string"), text, F.lit(seed)).alias("number"), text.alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.where("text is not null and lang is not null")
    # the share of a language's hashes that is let through, as a bound of the hash
    size = known.groupBy("lang").agg(F.approx_count_distinct("number", 0.02).alias("n"))
    bound = F.least(F.lit(1.0), F.lit(SPARE * PER_LANGUAGE) / F.greatest("n", F.lit(1)))
    bounds = common.checkpoint(size.select(F.col("lang").alias("of"), (bound * 2.0**64 - 2.0**63).alias("bound")))
    few = common.join_lookup(known.select("number", "lang"), bounds, F.col("lang") == F.col("of"), F.col("number"), "inner").where("number <= bound").select("lang", "number").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("number"))
    last = common.checkpoint(few.withColumn("rank", rank).where(F.col("rank") <= PER_LANGUAGE).groupBy(F.col("lang").alias("of")).agg(F.max("number").alias("last")))
    chosen = common.join_lookup(known, last, F.col("lang") == F.col("of"), F.col("number"), "inner").where("number <= last")
    windows = chosen.dropDuplicates(["number", "lang"]).select("number", "text", "lang").where("text rlike '\\\\p{L}'").mapInArrow(_sample(seed), "lang string, window binary")
    rows = windows.toArrow()
    if not rows.num_rows:
        return None
    langs = rows.column("lang").to_pylist()
    languages = sorted(set(langs))
    x = np.frombuffer(b"".join(rows.column("window").to_pylist()), np.uint8).reshape(len(langs), WINDOW)
    y = np.searchsorted(np.array(languages), np.array(langs))
    order = np.lexsort([*x.T[::-1], y])  # by label and the whole window: the same order however tasks were dealt
    network = Network.new(languages, seed)
    network.train(x[order], y[order], seed)
    return network


def _predict(network: Network | None, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.string()).to_pylist()
            predicted, scores = ["und"] * len(texts), [0.0] * len(texts)
            some = [i for i, t in enumerate(texts) if t and network and has_letter(t)]
            for at in range(0, len(some), 64):
                part = some[at : at + 64]
                windows = [windows_of(texts[i].encode().lower()) for i in part]
                starts = np.cumsum([0, *map(len, windows)])
                p = network.probabilities(np.concatenate(windows))
                for i, a, b in zip(part, starts[:-1], starts[1:], strict=True):
                    mean = p[a:b].mean(axis=0)
                    predicted[i], scores[i] = network.languages[int(mean.argmax())], min(1.0, float(mean.max()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(predicted, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, network: Network | None, text_col: str = "text") -> DataFrame:
    """The rows with lang_pred and score."""
    docs = docs.drop("lang_pred", "score")
    return docs.mapInArrow(_predict(network, text_col), T.StructType([*docs.schema.fields, *common.fields("lang_pred string, score double")]))
