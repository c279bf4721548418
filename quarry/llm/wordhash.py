"""Words of a text and Rabin-Karp hashes of all its word windows, for whole batches of texts at once.

Words are the maximal runs of characters other than space, tab, line feed, vertical tab, form feed
and carriage return: what ``bytes.split()`` yields on UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Odd multipliers for polynomials modulo 2**64: of the hash, and of a second one.
BASE, SECOND_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
#: Words in one block of texts: bounds a task's memory. A single longer text is a block of its own.
BLOCK_WORDS = 400_000


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, bound: int = 300_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int = BASE):
        self.base = base
        self.up = self.down = np.empty(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BLOCK_WORDS + 1)
            for name, factor in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer, so that any bits of a hash are fit for choosing buckets."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_hashes(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def window_places(ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of `width` words that lie within one text: the index of the text, the first word's position there and in the block.

    ends: where each text of a block ends.
    """
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    counts = np.maximum(ends - starts - width + 1, 0)
    text = np.repeat(np.arange(len(ends)), counts)
    position = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return text, position, position + starts[text]


def hashes_at(hashes: np.ndarray, at: np.ndarray, width: int, powers: Powers) -> np.ndarray:
    """Hashes of the windows of `width` words from the places `at` on. hashes: of the words of all texts of a block, one after another."""
    up, down = powers.upto(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[:-1], out=sums[1:])
    return mixed((sums[at + width] - sums[at]) * down[at])


def window_hashes(hashes: np.ndarray, ends: np.ndarray, width: int, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes, texts and positions of all windows of `width` words that lie within one text."""
    text, position, at = window_places(ends, width)
    return hashes_at(hashes, at, width, powers), text, position


def binary(column: pa.ChunkedArray | pa.Array) -> list:
    """Texts as UTF-8 bytes; null stays None."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def text_slices(batches: Iterable[pa.RecordBatch], text: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `most` bytes of the text column, or one text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < len(ends):
            last = max(first + 1, int(np.searchsorted(ends, most + (ends[first - 1] if first else 0), "right")))
            yield batch.slice(first, last - first)
            first = last


def blocks(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices of the batches with at most BLOCK_WORDS words, or one text, with the words of each text."""
    for batch in batches:
        first, words, total = 0, [], 0
        for i, t in enumerate(binary(batch.column(batch.schema.get_field_index(text)))):
            w = t.split() if t else []
            if words and total + len(w) > BLOCK_WORDS:
                yield batch.slice(first, i - first), words
                first, words, total = i, [], 0
            words.append(w)
            total += len(w)
        if words:
            yield batch.slice(first), words
