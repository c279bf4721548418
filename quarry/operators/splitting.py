"""Long texts cut into chunks: at the best separators by recursion, or by whole paragraphs. Table functions, joined laterally to the rows they cut."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", ". ", " ", "")

Span = tuple[int, int]


def pieces(text: str, low: int, high: int, separator: str) -> Iterator[Span]:
    """The stretches of text[low:high] that begin at its start and at each separator."""
    at = low
    while (cut := text.find(separator, max(at + len(separator), low + 1) if text.startswith(separator, at) else at, high)) >= 0:
        if cut > at:
            yield at, cut
        at = cut
    if at < high:
        yield at, high


def joined(spans: list[Span], size: int, overlap: int) -> Iterator[Span]:
    """Runs of adjacent stretches of at most `size` characters (or one stretch); each begins with what fits in `overlap` of the end of the one before."""
    first, total = 0, 0
    for k, (a, b) in enumerate(spans):
        if total + b - a > size and first < k:
            yield spans[first][0], spans[k - 1][1]
            while first < k and (total > overlap or total + b - a > size):
                total -= spans[first][1] - spans[first][0]
                first += 1
        total += b - a
    if first < len(spans):
        yield spans[first][0], spans[-1][1]


def recursive(text: str, low: int, high: int, size: int, overlap: int, separators: tuple[str, ...]) -> Iterator[Span]:
    """Chunks of text[low:high] at the first separator that occurs there; stretches between two that are of `size` or more are cut at the later separators."""
    k = next((k for k, s in enumerate(separators) if not s or text.find(s, low, high) >= 0), len(separators) - 1)
    if not separators[k]:  # single characters
        at = low
        while high - at > size:
            yield at, at + size
            at += size - overlap
        yield at, high
        return
    rest, short = separators[k + 1 :], []
    for a, b in pieces(text, low, high, separators[k]):
        if b - a < size:
            short.append((a, b))
            continue
        yield from joined(short, size, overlap)
        short = []
        if rest:
            yield from recursive(text, a, b, size, overlap, rest)
        else:
            yield a, b
    yield from joined(short, size, overlap)


def chunks_of(text: str | None, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[Span]:
    """Chunks without white space at their ends; empty ones are left out. A text of at most `size` characters is one chunk, as it is."""
    if not text or len(text) <= size:
        return [(0, len(text))] if text else []
    out = []
    for a, b in recursive(text, 0, len(text), size, overlap, separators):
        piece = text[a:b]
        left, right = len(piece) - len(piece.lstrip()), len(piece.rstrip())
        if right > left:
            out.append((a + left, a + right))
    return out


def paragraphs_of(text: str | None, size: int) -> list[str]:
    """Paragraphs, put together while they fit in `size` characters; what grows over twice that is cut hard, `size` characters at a time."""
    out, held = [], ""
    for paragraph in filter(None, (p.strip() for p in re.split(r"\n\n+", text or ""))):
        if held and len(held) + 2 + len(paragraph) > size:
            out.append(held)
            held = paragraph
        else:
            held = f"{held}\n\n{paragraph}" if held else paragraph
        while len(held) > 2 * size:
            out.append(held[:size])
            held = held[size:]
    return [*out, held] if held else out


@F.udtf(returnType="chunk int, total int, start int, text string")
class SplitText:
    def eval(self, text: str, size: int, overlap: int):
        found = chunks_of(text, size, overlap)
        for k, (a, b) in enumerate(found):
            yield k, len(found), a, text[a:b]


@F.udtf(returnType="chunk int, total int, text string")
class PackParagraphs:
    def eval(self, text: str, size: int):
        found = paragraphs_of(text, size)
        for k, piece in enumerate(found):
            yield k, len(found), piece


def split(docs: DataFrame, size: int = 1500, overlap: int = 100, header: Column | None = None, unless: str = "", text_col: str = "text") -> DataFrame:
    """The rows of docs for each chunk of their text, with chunk (from 0), total, start and chunk_text in its place.

    header: what chunks of texts that are cut begin with, unless they begin with `unless`. Null and empty texts have no chunks.
    """
    whole, rest = F.col(text_col).cast("string"), [c for c in docs.columns if c != text_col]
    title = (F.lit(None) if header is None else header).cast("string")
    cut = docs.select(*rest, whole.alias("whole_"), title.alias("title_")).lateralJoin(SplitText(F.col("whole_").outer(), F.lit(size), F.lit(overlap)))
    starts = F.col("text").startswith(unless) if unless else F.lit(False)
    shown = F.when((F.col("total") > 1) & F.col("title_").isNotNull() & ~starts, F.concat("title_", "text")).otherwise(F.col("text"))
    return cut.select(*rest, "chunk", "total", "start", shown.alias("chunk_text"))


def pack(docs: DataFrame, size: int = 1400, text_col: str = "text") -> DataFrame:
    """The rows of docs for each pack of paragraphs of their text, with chunk (from 0), total and chunk_text in its place."""
    rest = [c for c in docs.columns if c != text_col]
    cut = docs.select(*rest, F.col(text_col).cast("string").alias("whole_")).lateralJoin(PackParagraphs(F.col("whole_").outer(), F.lit(size)))
    return cut.select(*rest, "chunk", "total", F.col("text").alias("chunk_text"))
