"""Token ids in a content-addressed store.

Each document is encoded (the tokenizers library, no special tokens) and ends with END. Its ids are cut
into chunks where a rolling hash of the last WINDOW ids says so, so equal passages give equal chunks wherever they
stand. A chunk is stored once, under its BLAKE2b digest. Layout of a store, all Parquet:

    rows/kind=chunks/  digest, n, ids: little-endian, 2 bytes each (4 for vocabularies over 65,536), sorted by digest
    recipes/   seq, doc_id, start, n_tokens, digests, root               in ascending doc_id, so ascending start
    manifest/  level, part, documents, tokens, root                      Merkle roots: level 0 of parts of PART_ROWS recipes, each further one of
                                                                         PART_ROWS parts of the level below, up to one root

A recipe's root is the Merkle root of its chunk digests. Reading back
hashes every chunk file's content again, resolves every recipe through the chunks, and recomputes the roots; any difference raises.

White space never lies within a token of the default tokenizer (its normaliser turns it into one space and its pattern drops
that), so a text's ids are the joined ids of its words, or of the smaller units that its pattern cuts; each task remembers those of frequent ones. A vocabulary file with
another normaliser, pattern or added tokens is given whole texts.

Chunks are dealt by digest and recipes by a running number of their task, so equal documents don't meet in one task; rows of one id, or of none, are dealt by
their digests and that number. Chunks with more than HOT references are looked up apart, in a table of at most
a HOT-th of all references' rows, which is broadcast if it is small and else met by salted keys.

Defined results: a null text is empty and so one id, END; a text of more than BLOCK_BYTES is encoded by itself, whole, and cut into chunks like others. Rows with equal ids are documents of their own, in order of their digests; null ids come first; an
empty table makes an empty store. Only the id and text columns are read.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .wordhash import Powers, binary, window_hashes

END = 1
WINDOW, LEAST, MEAN_BITS, MOST = 16, 64, 8, 2048
DIGEST = 16
#: Recipes of a part, and parts of one of the next level.
PART_ROWS = 4096
#: References from which on a chunk is looked up apart from the others.
HOT = 1000
#: Chunks that a task remembers to have written.
STORED = 1_000_000
#: The normaliser and the pattern of tokenizers whose plain texts are cut here.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}
#: Kinds of a plain text's bytes in lower case. A unit is a run of one kind, but digits stand alone and white space is dropped.
WHITE, LETTER, DIGIT, MARK = range(4)
KINDS = np.array([WHITE if b in b" \t\n\v\f\r" else LETTER if b >= 0x80 or chr(b).islower() else DIGIT if chr(b).isdigit() else MARK for b in range(256)], np.uint8)
#: Bytes of texts that are cut at once.
BLOCK_BYTES = 4 << 20
#: First bytes of UTF-8 characters outside U+00C0 to U+024F.
FOREIGN = bytes([0xC2, *range(0xCA, 0xF5)])
#: In that range: the signs of multiplication and division, and the dotted capital I, whose lower case is two characters.
UNLIKE = ("×".encode(), "÷".encode(), "İ".encode())


def cuts_words(settings: dict) -> bool:
    """Whether a tokenizer file has the normaliser, pattern and kind of model that units and words may be encoded one by one with."""
    first = (settings.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    return (
        settings.get("normalizer") == NORMALIZER
        and first == [{"type": "Split", "pattern": PATTERN, "behavior": "Removed", "invert": True}, byte_level]
        and settings["model"]["type"] == "BPE"
        and all(t["content"].startswith("<") and not any(map(str.isspace, t["content"])) and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in settings["added_tokens"])
        and not any(settings.get(x) for x in ("truncation", "padding", "post_processor"))
    )


@cache
def tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if not os.path.isabs(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    return Tokenizer.from_file(name)


def byte_letters() -> list[str]:
    """The letter that byte-level pieces use for each byte: itself if it is visible in Latin-1, else the next from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(0x100 + hidden.index(b)) for b in range(256)]


class UnitIds(dict):
    """The ids of units, as little-endian bytes. Once `bound` are new, they replace the older ones.

    In a plain text (ASCII and Latin letters, no apostrophes, no <) the tokenizer's pattern splits exactly into runs of letters, single digits and
    runs of marks; these units are asked from the tokenizer's model itself. Any other text goes through the whole tokenizer by words,
    which it never joins.
    """

    def __init__(self, name: str, bound: int = 600_000):
        super().__init__()
        self.coder, self.bound = tokenizer(name), bound
        self.kind = np.dtype("<u2") if self.coder.get_vocab_size() <= 65536 else np.dtype("<u4")
        self.old: dict[bytes, bytes] = {}
        self.words: dict[bytes, bytes] = {}
        self.letters = byte_letters()
        self.merged = self.coder.model.tokenize
        self.by_word = cuts_words(json.loads(self.coder.to_str()))

    def __missing__(self, unit: bytes) -> bytes:
        ids = self.old.get(unit)
        if ids is None:
            text = unit.decode()
            if not (text.isascii() and text.isprintable()):
                text = "".join(map(self.letters.__getitem__, text.lower().encode()))
            found = self.merged(text)
            ids = pack(f"<{len(found)}{self.kind.char}", *[t.id for t in found])
        if len(self) >= self.bound:
            self.old = dict(self)
            self.clear()
        self[unit] = ids
        return ids

    def word(self, word: bytes) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            found = self.coder.encode(word.decode(), add_special_tokens=False).ids
            ids = pack(f"<{len(found)}{self.kind.char}", *found)
            if len(self.words) >= self.bound // 4:
                self.words.clear()
            self.words[word] = ids
        return ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text. Plain texts are cut into units together, and only distinct units are looked up one by one."""
        if not self.by_word:
            found = self.coder.encode_batch([text.decode() for text in texts], add_special_tokens=False)
            return [np.array(x.ids, self.kind).tobytes() for x in found]
        flat = [i for i, text in enumerate(texts) if text and plain(text)]
        found = dict(zip(flat, self._units([texts[i] for i in flat]), strict=True)) if flat else {}
        return [found[i] if i in found else b"".join(map(self.word, text.split())) for i, text in enumerate(texts)]

    def _units(self, texts: list[bytes]) -> list[bytes]:
        whole = np.frombuffer(b" ".join(texts).lower(), np.uint8)
        ends_of_texts = np.cumsum([len(t) + 1 for t in texts]) - 1
        kind = KINDS[whole]
        some = kind != WHITE
        cut = np.ones(len(whole) + 1, bool)
        cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        starts = np.flatnonzero(cut[:-1] & some)
        lengths = np.flatnonzero(cut[1:] & some) + 1 - starts
        offsets = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(lengths, out=offsets[1:])
        units = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(whole[some])]).dictionary_encode()
        data, at = units.dictionary.buffers()[2].to_pybytes(), np.frombuffer(units.dictionary.buffers()[1], np.int32)[: len(units.dictionary) + 1].tolist()
        known = [self[data[a:b]] for a, b in zip(at, at[1:], strict=False)]
        n_ids = np.array(list(map(len, known)), np.int64) // self.kind.itemsize
        first = np.cumsum(n_ids) - n_ids
        which = units.indices.to_numpy()
        each = n_ids[which]
        upto = np.concatenate(([0], np.cumsum(each)))
        flat = np.frombuffer(b"".join(known), self.kind)[np.repeat(first[which] - upto[:-1], each) + np.arange(upto[-1])]
        last = upto[np.searchsorted(starts, ends_of_texts)]
        return [x.tobytes() for x in np.split(flat, last[:-1])]


def plain(text: bytes) -> bool:
    """Whether all characters are ASCII or letters of U+00C0 to U+024F with one letter as lower case, but no apostrophe or <."""
    if b"'" in text or b"<" in text:
        return False
    return text.isascii() or (len(text.translate(None, FOREIGN)) == len(text) and not any(x in text for x in UNLIKE))


@cache
def unit_ids(name: str) -> UnitIds:
    return UnitIds(name)


def chunk_ends(streams: list[np.ndarray], powers: Powers) -> list[list[int]]:
    """Where each stream's chunks end: after a window whose hash has MEAN_BITS zeros; LEAST to MOST ids each, but for the last."""
    ids = np.concatenate(streams)
    spread = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    spread ^= spread >> np.uint64(32)
    hashes, stream, position = window_hashes(spread, np.cumsum([len(x) for x in streams]), WINDOW, powers)
    here = np.flatnonzero((hashes & np.uint64((1 << MEAN_BITS) - 1)) == 0)
    cuts, at = (position[here] + WINDOW).tolist(), np.searchsorted(stream[here], np.arange(len(streams) + 1)).tolist()
    out = []
    for k, x in enumerate(streams):
        n, ends, last = len(x), [], 0
        for c in [*cuts[at[k] : at[k + 1]], n]:
            while c - last > MOST:
                last += MOST
                ends.append(last)
            if c - last >= LEAST or (c == n and c > last):
                ends.append(c)
                last = c
        out.append(ends)
    return out


def slices(texts: list, most: int = BLOCK_BYTES) -> Iterator[slice]:
    """Runs of texts of at most `most` bytes, or one."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t or b"") > most:
            yield slice(first, i)
            first, size = i, 0
        size += len(t or b"")
    if first < len(texts):
        yield slice(first, len(texts))


def digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=DIGEST).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; a lone last node moves up unchanged."""
    level = [digest(b"\0" + x) for x in leaves] or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def split_digests(joined: bytes) -> list[bytes]:
    return [joined[i : i + DIGEST] for i in range(0, len(joined), DIGEST)]


_ROWS = "kind string, digest binary, n long, ids binary, doc_id long, deal long"


def _encode(name: str):
    schema = pa.schema([("kind", pa.string()), ("digest", pa.binary()), ("n", pa.int64()), ("ids", pa.binary()), ("doc_id", pa.int64()), ("deal", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, powers, stored, number = unit_ids(name), Powers(), set(), TaskContext.get().partitionId() << 33
        end, width = np.array([END], known.kind).tobytes(), known.kind.itemsize
        for batch in batches:
            all_docs, all_texts = batch.column(0).to_pylist(), [t or b"" for t in binary(batch.column(1))]
            for part in slices(all_texts):
                streams = [ids + end for ids in known.encode(all_texts[part])]
                rows = []
                for doc, data, ends in zip(all_docs[part], streams, chunk_ends([np.frombuffer(x, known.kind) for x in streams], powers), strict=True):
                    last, recipe = 0, []
                    for e in ends:
                        piece = data[last * width : e * width]
                        recipe.append(d := digest(piece))
                        if d not in stored:
                            stored.add(d)
                            rows.append(("chunks", d, e - last, piece, None, int.from_bytes(d[:8], "little", signed=True)))
                        last = e
                    number += 1
                    rows.append(("recipes", b"".join(recipe), last, None, doc, number))
                if len(stored) > STORED:
                    stored.clear()
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of consecutive chunks of one digest the first."""
    last = None
    for batch in batches:
        stay = []
        for kind, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            stay.append(kind != "chunks" or d != last)
            last = d
        yield batch.filter(pa.array(stay, pa.bool_()))


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recipes with their task, their place there and the tokens before them there."""
    task, at, start = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = batch.column(1).to_numpy()
        ends = np.cumsum(n)
        columns = {
            "doc_id": batch.column(0), "n_tokens": batch.column(1), "digests": batch.column(2),
            "root": pa.array([merkle(split_digests(x)) for x in batch.column(2).to_pylist()], pa.binary()),
            "task": pa.array(np.full(len(n), task), pa.int64()), "at": pa.array(np.arange(at, at + len(n))), "before": pa.array(start + ends - n, pa.int64()),
        }
        at, start = at + len(n), start + int(ends[-1]) if len(n) else start
        yield pa.RecordBatch.from_pydict(columns)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's leaves (at, root), which are in order, as their Merkle root."""
    for batch in batches:
        leaves = batch.column(batch.num_columns - 1)
        at, roots = leaves.offsets.to_pylist(), leaves.values.field("root").to_pylist()
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([merkle(roots[a:b]) for a, b in zip(at, at[1:], strict=False)], pa.binary())], [*batch.schema.names[:-1], "root"])


def _parts(nodes: DataFrame) -> DataFrame:
    """(part, documents, tokens, root) of nodes (at, documents, tokens, root): PART_ROWS successive ones make a part."""
    of = F.expr(f"at div {PART_ROWS}").alias("part")
    leaves = F.array_sort(F.collect_list(F.struct("at", "root"))).alias("leaves")
    return nodes.groupBy(of).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"), leaves).mapInArrow(_folded, "part long, documents long, tokens long, root binary")


def manifest(recipes: DataFrame) -> DataFrame:
    """(level, part, documents, tokens, root), up to the level of one part. Every level has PART_ROWS times fewer rows."""
    nodes, out, level = recipes.select(F.col("seq").alias("at"), F.lit(1).cast("long").alias("documents"), F.col("n_tokens").alias("tokens"), "root"), None, 0
    while True:
        parts = common.checkpoint(_parts(nodes))
        rows = parts.select(F.lit(level).alias("level"), "*")
        out = rows if out is None else out.unionAll(rows)
        if parts.limit(2).count() < 2:
            return out
        nodes, level = parts.withColumnRenamed("part", "at"), level + 1


def _rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One kind of the rows that were written; the schema is given, as an empty table leaves no files."""
    return spark.read.schema(f"{_ROWS}").parquet(f"{path}/rows").where(F.col("kind") == kind)


def write_store(docs: DataFrame, path: str, vocabulary: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode the documents and write their store to a new folder that all executors share."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = source.mapInArrow(_encode(vocabulary), _ROWS)
    dealt = rows.repartition(common.partitions(spark), F.col("deal")).sortWithinPartitions("kind", "digest")
    dealt.mapInArrow(_once, _ROWS).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/rows")
    recipes = _rows(spark, path, "recipes").select("doc_id", F.col("n").alias("n_tokens"), F.col("digest").alias("digests"), "deal")
    # many rows may share an id, or lack one, and have the same digests too
    ordered = recipes.repartitionByRange(common.partitions(spark), "doc_id", "digests", "deal").sortWithinPartitions("doc_id", "digests", "deal").drop("deal")
    placed = common.checkpoint(ordered.mapInArrow(_place, "doc_id long, n_tokens long, digests binary, root binary, task long, at long, before long"))
    # one row per task, so that a window over them is small
    sums = placed.groupBy("task").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("task", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("documents", "tokens")))
    final = placed.join(F.broadcast(offsets), "task").select(
        (F.col("documents_before") + F.col("at")).alias("seq"), "doc_id", (F.col("tokens_before") + F.col("before")).alias("start"), "n_tokens", "digests", "root"
    )
    final.write.option("compression", "zstd").parquet(f"{path}/recipes")
    manifest(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")


def _check_chunks(width: int):
    schema = pa.schema([("digest", pa.binary()), ("n", pa.int64()), ("crc", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(f"<u{width}")
        for batch in batches:
            crc, n = [], []
            for d, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest(ids) != d:
                    raise ValueError(f"chunk {d.hex()} has other content")
                crc.append(zlib.crc32(np.frombuffer(ids, kind).astype("<u4").tobytes()))
                n.append(len(ids) // width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], schema=schema)

    return run


#: The CRC-32 polynomial, lowest power in the highest bit.
CRC_POLYNOMIAL = 0xEDB88320


def crc_times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC polynomial."""
    product = 0
    for power in range(31, -1, -1):
        if a >> power & 1:
            product ^= b
        b = b >> 1 ^ (CRC_POLYNOMIAL if b & 1 else 0)
    return product


@cache
def crc_shift(n_ids: int) -> int:
    """The polynomial x**(32 * n_ids) modulo the CRC polynomial."""
    result, square, n = 1 << 31, 1 << 30, 32 * n_ids
    while n:
        if n & 1:
            result = crc_times(result, square)
        square = crc_times(square, square)
        n >>= 1
    return result


def crc_joined(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of joined id streams from (ids, CRC-32) of each."""
    total = parts[0][1]
    for n, crc in parts[1:]:
        total = crc_times(crc_shift(n), total) ^ crc
    return total


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seqs, roots, sizes, parts = (batch.column(batch.schema.get_field_index(c)) for c in ("seq", "root", "n_tokens", "parts"))
        at = parts.offsets.to_pylist()
        digests, n, crcs = (parts.values.field(c).to_pylist() for c in ("digest", "n", "crc"))
        crc = []
        for seq, root, size, a, b in zip(seqs.to_pylist(), roots.to_pylist(), sizes.to_pylist(), at, at[1:], strict=False):
            if None in n[a:b] or sum(n[a:b]) != size or merkle(digests[a:b]) != root:
                raise ValueError(f"document {seq} of the stream differs from its recipe")
            crc.append(crc_joined(list(zip(n[a:b], crcs[a:b], strict=True))))
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def _references(recipes: DataFrame) -> DataFrame:
    return recipes.select(
        "seq", "doc_id", "start", "n_tokens", "root",
        F.posexplode(F.expr(f"transform(sequence(0, length(digests) div {DIGEST} - 1), i -> substring(digests, int(i) * {DIGEST} + 1, {DIGEST}))")).alias("k", "digest"),
    )


def id_bytes(vocabulary: str) -> int:
    return unit_ids(vocabulary).kind.itemsize


def verify_store(spark: SparkSession, path: str, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the store's files, all of whose hashes are checked."""
    recipes = spark.read.parquet(f"{path}/recipes")
    stored, again = spark.read.parquet(f"{path}/manifest"), manifest(recipes)
    keys = ["level", "part", "documents", "tokens", "root"]
    if wrong := stored.join(again, keys, "left_anti").unionAll(again.join(stored, keys, "left_anti")).limit(1).collect():
        raise ValueError(f"part {wrong[0]['part']} of level {wrong[0]['level']} of the recipes differs from the manifest")
    chunks = _rows(spark, path, "chunks").select("digest", "ids").mapInArrow(_check_chunks(id_bytes(vocabulary)), "digest binary, n long, crc long")
    chunks, references = common.checkpoint(chunks), _references(recipes)
    hot = references.groupBy("digest").count().where(F.col("count") > HOT).select("digest")
    often = common.checkpoint(chunks.join(hot, "digest", "left_semi")).toDF("often", "n", "crc")
    marked = common.join_lookup(references, often, references["digest"] == often["often"], F.xxhash64(references["seq"]))
    rest = marked.where("often IS NULL").drop("often", "n", "crc").join(chunks, "digest", "left")
    found = rest.unionByName(marked.where("often IS NOT NULL").drop("often"))
    parts = found.groupBy("seq", "doc_id", "start", "n_tokens", "root").agg(F.array_sort(F.collect_list(F.struct("k", "digest", "n", "crc"))).alias("parts"))
    return parts.mapInArrow(_resolve, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_store(spark: SparkSession, path: str, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """(doc_id, start, ids): the documents' ids, put together from their chunks. A chunk that many share is left to Spark's own splitting of skewed joins."""
    chunks = _rows(spark, path, "chunks").select("digest", F.col("ids").alias("piece"))
    found = _references(spark.read.parquet(f"{path}/recipes")).join(chunks, "digest")
    whole = found.groupBy("seq", "doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("k", "piece"))).alias("parts"))
    kind = np.dtype(f"<u{id_bytes(vocabulary)}")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["piece"] for p in parts), kind).astype(np.int32) for parts in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    return whole.select("doc_id", "start", "parts").mapInArrow(joined, "doc_id long, start long, ids array<int>")


def new_path(spark: SparkSession) -> str:
    return f"{common.shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
