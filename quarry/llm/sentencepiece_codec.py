"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a one-pass Viterbi.

A text's best segmentation has the highest sum of piece scores. The automaton reads each character once; from its state
the output links give every piece that ends there, longest first, and each relaxes the best score at that
position. A character that is no piece costs UNKNOWN below the lowest score and becomes its UTF-8 bytes as byte pieces, so decoding gives
back any text exactly. Of equal sums the one whose last piece is longer wins, position by position.

Pieces with a space have it in front only, so a text falls into parts (spaces and what follows them; line feeds, which no
piece holds, by themselves) with independent segmentations; a task remembers those of frequent parts. A model for which
that doesn't hold is segmented in one go. Unknown parts of a block of texts advance through the automaton together, as arrays.

Spaces are the model's U+2581, with one in front of the text, as its own rules say; a U+2581 in a text goes through byte pieces.

Defined results: a null text has no pieces and decodes to null; an empty text has no pieces and decodes to an empty one; repeated rows are coded each; texts of any length are coded whole, their parts some at a
time; an empty table stays empty. The model's own normaliser is left out, so that decoding gives back every text. Columns of the names added are replaced, all others pass.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

UNKNOWN = 10.0
INFINITE = float("inf")
#: Characters of texts cut at once, and the longest parts, and most of them, that are segmented together.
BLOCK_CHARACTERS, TOGETHER, GROUP = 4_000_000, 48, 20_000
SPACE = "▁"


class Automaton:
    """Aho-Corasick over pieces; node 0 is the root. Transitions are one dictionary of (node << 21 | character)."""

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        self.step: dict[int, int] = {}
        self.piece, self.score, self.depth = [-1], [0.0], [0]
        children: list[list[tuple[int, int]]] = [[]]
        for text, (number, score) in pieces.items():
            node = 0
            for c in map(ord, text):
                after = self.step.get(node << 21 | c)
                if after is None:
                    after = self.step[node << 21 | c] = len(self.piece)
                    children[node].append((c, after))
                    children.append([])
                    self.piece.append(-1)
                    self.score.append(0.0)
                    self.depth.append(self.depth[node] + 1)
                node = after
            self.piece[node], self.score[node] = number, score
        self.fail, self.link = [0] * len(self.piece), [0] * len(self.piece)
        self.ends: list[list | None] = [None] * len(self.piece)
        self.jumps: dict[int, int] = {}
        level = [0]
        while level:
            below = []
            for node in level:
                for c, child in children[node]:
                    below.append(child)
                    if node:
                        at = self.fail[node]
                        while at and (at << 21 | c) not in self.step:
                            at = self.fail[at]
                        self.fail[child] = at = self.step.get(at << 21 | c, 0)
                        self.link[child] = at if self.piece[at] >= 0 else self.link[at]
            level = below

    def after(self, node: int, c: int) -> int:
        """The next node by failure links; remembered as a transition, up to a bound."""
        key = node << 21 | c
        while (found := self.step.get(node << 21 | c)) is None and node:
            node = self.fail[node]
        found = found or 0
        if len(self.jumps) < 400_000:
            self.jumps[key] = found
        return found

    def outputs(self, node: int) -> list[tuple[int, float, int]]:
        """(length, score, node) of the pieces that end at a node, longest first, along the output links."""
        found, out = [], node if self.piece[node] >= 0 else self.link[node]
        while out:
            found.append((self.depth[out], self.score[out], out))
            out = self.link[out]
        self.ends[node] = found
        return found


class Table:
    """The automaton as arrays, to advance many texts at once. Transitions are an open-addressing hash table."""

    def __init__(self, a: Automaton):
        self.bits = max(4, (3 * len(a.step)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.targets = np.zeros(1 << self.bits, np.int32)
        keys, targets = np.fromiter(a.step.keys(), np.int64, len(a.step)), np.fromiter(a.step.values(), np.int32, len(a.step))
        slots = self._slot(keys)
        while len(keys):  # each round places one key of every free slot, and moves the rest on
            free = self.keys[slots] == -1
            _, one = np.unique(slots[free], return_index=True)
            placed = np.flatnonzero(free)[one]
            self.keys[slots[placed]], self.targets[slots[placed]] = keys[placed], targets[placed]
            rest = np.ones(len(keys), bool)
            rest[placed] = False
            keys, targets, slots = keys[rest], targets[rest], (slots[rest] + 1) & ((1 << self.bits) - 1)
        self.fail, self.link, self.depth = (np.array(x, np.int32) for x in (a.fail, a.link, a.depth))
        self.piece, self.score = np.array(a.piece, np.int64), np.array(a.score)
        self.first = np.where(self.piece >= 0, np.arange(len(self.piece), dtype=np.int32), self.link)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Targets, or -1."""
        slots = self._slot(keys)
        held = self.keys[slots]
        out = np.where(held == keys, self.targets[slots], -1)
        left = np.flatnonzero((held != keys) & (held != -1))
        while len(left):
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slots[left]]
            hit = held == keys[left]
            out[left[hit]] = self.targets[slots[left[hit]]]
            left = left[~hit & (held != -1)]
        return out

    def after(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The next node of each, along failure links where there is no transition."""
        out = self._find(nodes.astype(np.int64) << 21 | chars)
        left = np.flatnonzero(out < 0)
        at = nodes[left]
        while len(left):
            root = at == 0
            out[left[root]] = 0
            left, at = left[~root], self.fail[at[~root]]
            found = self._find(at.astype(np.int64) << 21 | chars[left])
            hit = found >= 0
            out[left[hit]] = found[hit]
            left, at = left[~hit], at[~hit]
        return out.astype(np.int32)

    def segment(self, texts: list[str], unknown: float, kind: np.dtype) -> list[bytes | None]:
        """The ids of each text, longest texts first; None for one with a character that is no piece."""
        lengths = np.array(list(map(len, texts)))
        n, longest = len(texts), int(lengths[0]) if len(texts) else 0
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        begin = np.cumsum(lengths) - lengths
        best, back = np.full((longest + 1, n), -np.inf), np.zeros((longest + 1, n), np.int32)
        best[0] = 0
        strange = np.zeros(n, bool)
        node = np.zeros(n, np.int32)
        for t in range(longest):
            m = int(np.searchsorted(-lengths, -t))  # of the texts with more than t characters
            node[:m] = self.after(node[:m], codes[begin[:m] + t])
            out = self.first[node[:m]]
            who = np.flatnonzero(out)
            out, least = out[who], np.zeros(m, np.int32)
            while len(who):
                length = self.depth[out]
                least[who] = length
                total = best[t + 1 - length, who] + self.score[out]
                better = total > best[t + 1, who]
                best[t + 1, who[better]], back[t + 1, who[better]] = total[better], out[better]
                out = self.link[out]
                more = out > 0
                who, out = who[more], out[more]
            strange[:m] |= least != 1
        ids = np.full((n, longest), -1, np.int64)
        position, step = lengths.copy(), longest
        who = np.flatnonzero(~strange & (lengths > 0))
        while len(who):
            step -= 1
            out = back[position[who], who]
            ids[who, step] = self.piece[out]
            position[who] -= self.depth[out]
            who = who[position[who] > 0]
        valid = ids >= 0
        cuts = np.cumsum(valid.sum(axis=1)) * kind.itemsize
        flat = ids[valid].astype(kind).tobytes()
        return [None if s else flat[a:b] for s, a, b in zip(strange.tolist(), [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]


class Codec:
    def __init__(self, model: str, remembered: int = 120_000):
        import sentencepiece

        if not os.path.isabs(model):
            import public_tokenizers

            model = public_tokenizers.path(model)
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        size = sp.get_piece_size()
        normal = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        pieces = {sp.id_to_piece(i).replace(SPACE, " "): (i, sp.get_score(i)) for i in normal}
        self.kind = np.dtype("<u2") if size <= 65536 else np.dtype("<u4")
        self.unknown = min(score for _, score in pieces.values()) - UNKNOWN
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes_of = [b""] * size
        for text, (i, _) in pieces.items():
            self.bytes_of[i] = text.encode()
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])
        self.automaton = Automaton(pieces)
        self.free = not any(" " in p.lstrip(" ") or ("\n" in p and len(p) > 1) for p in pieces)
        self.parts = re.compile(r"\n| *[^ \n]+| +" if self.free else r"(?s).+").findall
        # of frequent parts; once `remembered` are new, they replace the old ones
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.remembered = remembered
        self.table = Table(self.automaton)

    def segment(self, text: str) -> tuple[list[int], float]:
        """The ids of the best segmentation and its score."""
        a = self.automaton
        step, jumps, after, ends, outputs, unknown = a.step.get, a.jumps.get, a.after, a.ends, a.outputs, self.unknown
        best, back = [0.0], [0]
        node = 0
        for i, c in enumerate(map(ord, text)):
            key = node << 21 | c
            node = step(key) or jumps(key)
            if node is None:
                node = after(key >> 21, c)
            top, chosen, length = -INFINITE, -1, 0
            for length, score, out in ends[node] or outputs(node):
                total = best[i + 1 - length] + score
                if total > top:
                    top, chosen = total, out
            if length != 1 and best[i] + unknown > top:
                top, chosen = best[i] + unknown, -1
            best.append(top)
            back.append(chosen)
        piece, depth = a.piece, a.depth
        ids, at = [], len(text)
        while at:
            if back[at] < 0:
                ids += [self.byte_ids[b] for b in reversed(text[at - 1].encode())]
                at -= 1
            else:
                ids.append(piece[back[at]])
                at -= depth[back[at]]
        return ids[::-1], best[-1]

    def packed(self, text: str) -> bytes:
        ids = self.segment(text)[0]
        return pack(f"<{len(ids)}{self.kind.char}", *ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian bytes; of a null or empty one none."""
        if not self.free:
            return [self.packed(" " + t) if t else b"" for t in texts]
        out, block, size = [b""] * len(texts), [], 0
        for i, text in enumerate(texts):
            if text:
                block.append(i)
                size += len(text)
            if block and (size > BLOCK_CHARACTERS or i == len(texts) - 1):
                for k, ids in zip(block, self._block([(" " + texts[k]).encode() for k in block]), strict=True):
                    out[k] = ids
                block, size = [], 0
        return out

    def _block(self, texts: list[bytes]) -> list[bytes]:
        """Cut into parts together; only distinct parts are looked up, and only unknown ones are segmented."""
        whole = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        start = np.ones(len(whole), bool)
        start[1:] = ((whole[1:] == 32) & (whole[:-1] != 32)) | (whole[1:] == 10) | (whole[:-1] == 10)
        start[ends[:-1]] = True
        at = np.append(np.flatnonzero(start), len(whole)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(whole)]).dictionary_encode()
        data, cut = parts.dictionary.buffers()[2].to_pybytes(), np.frombuffer(parts.dictionary.buffers()[1], np.int32)[: len(parts.dictionary) + 1].tolist()
        distinct = [data[a:b] for a, b in zip(cut, cut[1:], strict=False)]
        found = [self.known.get(p) or self.old.get(p) for p in distinct]
        missing = [i for i, f in enumerate(found) if f is None]
        for i, ids in zip(missing, self.segment_all([distinct[i].decode() for i in missing]), strict=True):
            found[i] = ids
        if len(self.known) + len(missing) > self.remembered:
            self.old, self.known = self.known, {}
        self.known.update((p, f) for p, f in zip(distinct, found, strict=True) if len(p) <= 40)
        n_ids = np.array(list(map(len, found)), np.int64) // self.kind.itemsize
        first = np.cumsum(n_ids) - n_ids
        which = parts.indices.to_numpy()
        each = n_ids[which]
        upto = np.concatenate(([0], np.cumsum(each)))
        flat = np.frombuffer(b"".join(found), self.kind)[np.repeat(first[which] - upto[:-1], each) + np.arange(upto[-1])]
        return [x.tobytes() for x in np.split(flat, upto[np.searchsorted(at, ends[:-1])])]

    def segment_all(self, parts: list[str]) -> list[bytes]:
        """Ids of each part, as bytes: all parts of a group advance through the automaton together, one character a step."""
        out = [b""] * len(parts)
        short = []
        for i, p in enumerate(parts):
            if len(p) <= TOGETHER:
                short.append(i)
            else:
                out[i] = self.packed(p)
        short.sort(key=lambda i: -len(parts[i]))
        for at in range(0, len(short), GROUP):
            group = short[at : at + GROUP]
            for i, ids in zip(group, self.table.segment([parts[i] for i in group], self.unknown, self.kind), strict=True):
                out[i] = self.packed(parts[i]) if ids is None else ids
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))[1:].decode()


@cache
def codec(model: str) -> Codec:
    return Codec(model)


def _encode(model: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            data = c.encode(batch.column(batch.schema.get_field_index(text_col)).cast(pa.string()).to_pylist())
            ends = np.cumsum([0, *(len(d) // c.kind.itemsize for d in data)], dtype=np.int32)
            flat = np.frombuffer(b"".join(data), c.kind).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            crc = pa.array([zlib.crc32(np.frombuffer(d, c.kind).astype("<u4").tobytes()) for d in data], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, pa.array(np.diff(ends).astype(np.int64)), crc], [*batch.schema.names, "ids", "n_pieces", "ids_crc32"])

    return run


def _decode(model: str, ids_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col))
            flat, offsets = ids.values.to_numpy(), ids.offsets.to_numpy()
            texts = [c.decode(flat[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return run


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", text_col: str = "text") -> DataFrame:
    """The rows with ids (array of piece ids), n_pieces and ids_crc32 (of little-endian unsigned 32-bit ids)."""
    docs = docs.drop("ids", "n_pieces", "ids_crc32")
    return docs.mapInArrow(_encode(model, text_col), T.StructType([*docs.schema.fields, *common.fields("ids array<int>, n_pieces long, ids_crc32 long")]))


def decode(encoded: DataFrame, model: str = "piece_bpe_32k.model", ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """The rows with decoded, the text of the ids; null where `text_col` is."""
    encoded = encoded.drop("decoded")
    out = encoded.mapInArrow(_decode(model, ids_col), T.StructType([*encoded.schema.fields, *common.fields("decoded string")]))
    return out.withColumn("decoded", F.when(F.col(text_col).isNotNull(), F.col("decoded")))
