"""N-gram Jaccard join with Bayesian candidate pruning (BayesLSH, Satuluri and Parthasarathy 2012).

Documents are sets of five-word shingles; two are linked if the Jaccard similarity of their sets is
at least 0.8. The steps:

1. Each document gets a fingerprint of its set, its size and 128 MinHash values. Documents of equal
   sets are one node, with a multiplicity, so exact copies never meet pairwise.
2. Nodes that agree on a band of 4 MinHash values are candidates of each other; 32 bands find a pair of
   similarity 0.8 but for a chance of (1 - 0.8**4)**32 = 5e-8. Lower thresholds get narrower bands, so that this chance stays below 1e-6. The nodes of a bucket meet in one task, with a byte of each MinHash value, or
   in pairs of blocks of BUCKET nodes. There, matches are counted CHUNK by CHUNK, and a
   pair is dropped once the posterior probability, under a uniform prior, that its similarity reaches the
   threshold falls below `tolerance`. (Bytes may match where values don't, which only keeps more pairs.) Of the rest, links enough to
   connect what they connect leave the task: pairs that are connected already aren't compared, so a bucket of near copies takes one round over it.
3. Connected components of these links are clusters, outside of which no pair is left. Bucket mates that aren't similar, of templated pages, say, don't
   join clusters. Clusters are dealt to tasks in pairs of blocks of at most BLOCK nodes (and BLOCK_SHINGLES shingles),
   so that memory stays bounded for any cluster. A task compares and prunes as above with whole MinHash values; the rest is verified exactly on the sets.
4. Tasks return rows per node (number of links, smallest node reached), not pairs; the groups are the
   connected components of these verified links.

Words are runs of characters other than ASCII white space, unchanged. A text of one to four words
has one shingle, all its words. Defined results: texts without words and null texts have no links; of rows that share a doc_id each different text is a document of
its own with a row of its own, and repeated rows count once; a null doc_id has no links and a null class, and all rows without one share one row; an empty table stays empty; all shingles of
a text of any length count, and one of more than a block's words is sketched by itself.
Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .wordhash import Powers, WordHashes, blocks, window_hashes, word_hashes

WIDTH, THRESHOLD = 5, 0.8
HASHES, CHUNK = 128, 32
#: Values of a band, most selective first, and the most that the chance to miss a pair at the threshold may be.
ROWS, MISSED = (4, 2, 1), 1e-6
BLOCK, BLOCK_SHINGLES = 512, 2_000_000
#: Nodes of a block of a bucket, and of groups that are compared one by one; smaller groups are compared together.
BUCKET, TOGETHER = 1024, 32
FACTORS = np.random.default_rng(7).integers(0, 1 << 31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)


def band_rows(threshold: float) -> int:
    """MinHash values of a band: as many as let a pair at the threshold be missed with a chance of MISSED at most. Below 0.103 no banding of HASHES values does."""
    for rows in ROWS:
        if (1 - threshold**rows) ** (HASHES // rows) <= MISSED:
            return rows
    raise ValueError(f"a threshold of {threshold} is below what {HASHES} MinHash values can find")


@cache
def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """After n compared MinHash values: the fewest matches with P(similarity >= threshold) >= tolerance.

    Under a uniform prior that probability is the one of at most m successes in n + 1 trials of chance `threshold`.
    """
    least = {}
    for n in range(CHUNK, HASHES + 1, CHUNK):
        total = 0.0
        for m in range(n + 1):
            total += exp(lgamma(n + 2) - lgamma(m + 1) - lgamma(n + 2 - m) + m * log(threshold) + (n + 1 - m) * log(1 - threshold))
            if total >= tolerance:
                least[n] = m
                break
    return least


def shingle_sets(words: list[list[bytes]], width: int, cache_: WordHashes, powers: Powers) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a block."""
    long = [w for w in words if len(w) >= width]
    flat = np.concatenate([word_hashes(w, cache_) for w in long] or [np.empty(0, np.uint64)])
    hashes, _, _ = window_hashes(flat, np.cumsum([len(w) for w in long], dtype=np.int64), width, powers)
    out, at = [], 0
    for w in words:
        if len(w) >= width:
            out.append(np.unique(hashes[at : at + len(w) - width + 1]))
            at += len(w) - width + 1
        elif w:
            out.append(window_hashes(word_hashes(w, cache_), np.array([len(w)]), len(w), powers)[0])
        else:
            out.append(np.empty(0, np.uint64))
    return out


def minhash(shingles: np.ndarray) -> np.ndarray:
    low = shingles.astype(np.uint32)
    parts = [np.multiply.outer(FACTORS, low[i : i + 4096]).min(axis=1) for i in range(0, len(low), 4096)]
    return np.minimum.reduce(parts)


def one_byte(values: np.ndarray) -> np.ndarray:
    """A byte of each MinHash value: they are small numbers, so all their bits count."""
    return (values * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)


def _sketch(width: int):
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("sig", pa.binary()), ("low", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache_, powers = WordHashes(), Powers()
        for batch, words in blocks(batches, "text_"):
            n, f1, f2, sig, low = [], [], [], [], []
            for s in shingle_sets(words, width, cache_, powers):
                n.append(len(s))
                some = len(s) > 0
                f1.append(int(s.sum().view(np.int64)) if some else None)
                f2.append(int(((s ^ (s >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)).sum().view(np.int64)) if some else None)
                values = minhash(s) if some else None
                sig.append(values.tobytes() if some else None)
                low.append(one_byte(values).tobytes() if some else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip((n, f1, f2, sig, low), schema.types[1:], strict=True))], schema=schema)

    return run


def _shingles(width: int):
    schema = pa.schema([("node", pa.int64()), ("f1", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache_, powers = WordHashes(), Powers()
        for batch, words in blocks(batches, "text_"):
            sets = shingle_sets(words, width, cache_, powers)
            sums = [int(s.sum().view(np.int64)) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], schema=schema)

    return run


def compare(rows: list[dict], two: bool, threshold: float, tolerance: float) -> list[tuple[int, int, int]]:
    """(node, links, smallest node of its part) for the pairs within one block or, if `two`, between two."""
    rows = list({r["node"]: r for r in rows}.values())
    sides = np.array([r["own"] for r in rows])
    nodes = np.array([r["node"] for r in rows])
    sizes = np.array([r["n"] for r in rows], np.int64)
    copies = np.array([r["copies"] for r in rows], np.int64)
    sig = np.stack([np.frombuffer(r["sig"], np.uint32) for r in rows])
    sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a in range(len(rows)):
        b = np.flatnonzero(sides > sides[a]) if two else np.arange(a + 1, len(rows))
        matches = np.zeros(len(b), np.int64)
        for n, least in least_matches(threshold, tolerance).items():
            matches += (sig[b, n - CHUNK : n] == sig[a, n - CHUNK : n]).sum(axis=1)
            stay = matches >= least
            b, matches = b[stay], matches[stay]
            if not len(b):
                break
        left.append(np.full(len(b), a))
        right.append(b)
    left, right = np.concatenate(left), np.concatenate(right)
    if not len(left):
        return []
    common_ = intersections(sets, left, right)
    linked = common_ * (1 + threshold) >= threshold * (sizes[left] + sizes[right]) - 1e-9
    left, right = left[linked], right[linked]
    links = np.bincount(left, copies[right], len(rows)) + np.bincount(right, copies[left], len(rows))
    part = np.argsort(np.argsort(nodes))  # ranks, so that the smallest label is the smallest node
    by_rank = np.argsort(nodes)
    while True:
        before = part.copy()
        np.minimum.at(part, left, part[right])
        np.minimum.at(part, right, part[left])
        part = np.minimum(part, part[by_rank[part]])
        if (part == before).all():
            break
    return [(int(nodes[i]), int(links[i]), int(nodes[by_rank[part[i]]])) for i in np.flatnonzero(links)]


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the common parts: by products of 0/1 matrices over the shingles that several members have."""
    used = np.unique(np.concatenate((left, right)))
    if len(left) <= 2 * len(used):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right, strict=True)], np.int64)
    values, counts = np.unique(np.concatenate([sets[i] for i in used]), return_counts=True)
    values = values[counts > 1]
    row = np.zeros(len(sets), np.int64)
    row[used] = np.arange(len(used))
    total = np.zeros((len(used), len(used)), np.float32)
    for at in range(0, len(values), 8192):
        part = values[at : at + 8192]
        has = np.zeros((len(used), len(part)), np.float32)
        for k, i in enumerate(used):
            s = sets[i][np.searchsorted(sets[i], part[0]) : np.searchsorted(sets[i], part[-1], "right")]
            p = np.minimum(np.searchsorted(part, s), len(part) - 1)
            has[k, p[part[p] == s]] = 1
        total += has @ has.T
    return total[row[left], row[right]].astype(np.int64)


def _surviving(sig: np.ndarray, a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that pruning keeps."""
    matches = np.zeros(max(len(a), len(b)), np.int64)
    a = np.broadcast_to(a, matches.shape)
    for n, fewest in least.items():
        matches = matches + (sig[a, n - CHUNK : n] == sig[b, n - CHUNK : n]).sum(axis=1)
        stay = matches >= fewest
        a, b, matches = a[stay], b[stay], matches[stay]
        if not len(b):
            break
    return a, b


def connected(sig: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Labels of the components that pruning leaves of one group; pairs that are connected already aren't compared."""
    label = np.arange(len(sig))
    for a in range(len(sig) - 1):
        b = np.flatnonzero(label[a + 1 :] != label[a]) + a + 1
        if not len(b):
            continue
        _, b = _surviving(sig, np.array([a]), b, least)
        if len(b):
            joined = np.unique(np.append(label[b], label[a]))
            label[np.isin(label, joined)] = joined[0]
    return label


def small_groups(group: np.ndarray, sig: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """The same labels for many small groups, whose rows lie together: pairs at the same distance are compared at once."""
    label = np.arange(len(group))
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for distance in range(1, len(group)):
        a = np.flatnonzero(group[distance:] == group[:-distance])
        if not len(a):
            break
        a, b = _surviving(sig, a, a + distance, least)
        left.append(a)
        right.append(b)
    left, right = np.concatenate(left), np.concatenate(right)
    while True:
        before = label.copy()
        np.minimum.at(label, left, label[right])
        np.minimum.at(label, right, label[left])
        if (label == before).all():
            return label


def _links(threshold: float, tolerance: float):
    """Links (a, b) that connect what pruning leaves of each bucket. Input: rows sorted by key, i, j."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = least_matches(threshold, tolerance)

        def linked(nodes: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
            other = nodes[label] != nodes
            return pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[label[other]])], schema=schema)

        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in _and_none(batches):
            if batch is not None and batch.num_rows:
                keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
                sig = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(batch.num_rows, HASHES)
                kept.append((keys, batch.column(3).to_numpy(), sig))
            if not kept or (batch is not None and not batch.num_rows):
                continue
            last = kept[-1][0][-1]
            if batch is not None and (kept[-1][0][0] == last).all():
                continue  # the whole batch may be part of a group that goes on
            keys, nodes, sig = (np.concatenate(x) for x in zip(*kept, strict=True))
            group = np.concatenate(([0], np.cumsum((keys[1:] != keys[:-1]).any(axis=1))))
            end = len(group) if batch is None else int(np.searchsorted(group, group[-1]))
            kept = [] if batch is None else [(keys[end:], nodes[end:], sig[end:])]
            sizes = np.bincount(group[:end])
            small = sizes[group[:end]] <= TOGETHER
            at = np.flatnonzero(small)
            if len(at):
                yield linked(nodes[at], small_groups(group[at], sig[at], least))
            for g in np.flatnonzero(sizes > TOGETHER):
                x, y = np.searchsorted(group, [g, g + 1])
                yield linked(nodes[x:y], connected(sig[x:y], least))

    return run


def _and_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _verify(threshold: float, tolerance: float):
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("part", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if (k := (r["cluster"], r["i"], r["j"])) != key:
                    out += compare(rows, key[1] != key[2], threshold, tolerance) if len(rows) > 1 else []
                    key, rows = k, []
                rows.append(r)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=schema)
        if len(rows) > 1 and (out := compare(rows, key[1] != key[2], threshold, tolerance)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=schema)

    return run


def numbered(docs: DataFrame, row: str, id_col: str = "doc_id", text_col: str = "text", unnamed: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """The rows with a number of their own for each different text of an id, as column `row`, and (row, id) of the numbers that are not the id itself, if any.

    The text of the smallest digest has its id as number, the others have numbers above all ids. Rows without an id have none or, if `unnamed`, numbers above all ids by their text.
    """
    own = F.col(id_col).cast("long")
    counted = docs.groupBy(own.alias("many")).agg(F.count("*").alias("n"))
    many = common.checkpoint(counted.where("if(many is null, %s, n > 1)" % str(unnamed).lower()).select("many"))
    plain = docs.withColumn(row, own)
    if many.isEmpty():
        return plain, None
    digest = F.md5(F.concat(F.col(text_col).isNull().cast("string"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    kinds = docs.select(own.alias("of"), digest.alias("digest")).distinct()
    texts = common.checkpoint(kinds.join(many, kinds["of"].eqNullSafe(many["many"]), "left_semi"))
    first = texts.where("of is not null").groupBy(F.col("of").alias("first_of")).agg(F.min("digest").alias("first"))
    top = docs.agg(F.coalesce(F.max(own), F.lit(0))).first()[0]
    others = texts.join(first, texts["of"] == first["first_of"], "left").where("of is null OR digest <> first")
    more = common.checkpoint(others.select("of", "digest", (F.monotonically_increasing_id() + top + 1).alias("number")))
    if more.isEmpty():
        return plain, None
    names = common.free_names(plain, "of_", "digest_", "number_")
    more = more.toDF(*names)
    joined = common.join_lookup(docs, more, own.eqNullSafe(more[names[0]]) & (digest == more[names[1]]), F.xxhash64(digest))
    return joined.withColumn(row, F.coalesce(names[2], own)).drop(*names), more.select(F.col(names[2]).alias("row"), F.col(names[0]).alias("id"))


def similarity_groups(
    docs: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, tolerance: float = 1e-9, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document id: doc_id, class_id (smallest id of its group), copy_of (smallest id of an equal set), n_links, n_shingles."""
    rows, renamed = numbered(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("whole")), "id", "doc", "whole")
    source = rows.select("id", F.when(F.col("id").isNotNull(), F.col("whole")).alias("text_"))
    sketched = common.checkpoint(source.mapInArrow(_sketch(width), "id long, n long, f1 long, f2 long, sig binary, low binary"))
    one = sketched.groupBy("id").agg(F.min(F.struct(F.col("f1").isNull().alias("none"), "f1", "f2", "n")).alias("s")).select("id", "s.f1", "s.f2", "s.n")
    one = common.checkpoint(one)
    classes = common.checkpoint(
        one.where("id is not null and f1 is not null").groupBy("f1", "f2", "n").agg(F.min("id").alias("node"), F.count("*").alias("copies"))
    )
    nodes = classes.join(sketched.withColumnRenamed("id", "node"), ["node", "f1", "f2", "n"]).select("node", "n", "f1", "copies", "sig", "low")
    width_of_band = 4 * band_rows(threshold)
    bands = nodes.select(
        "node", F.explode(F.expr(f"transform(sequence(0, {4 * HASHES // width_of_band - 1}), b -> xxhash64(b, substring(sig, b * {width_of_band} + 1, {width_of_band})))")).alias("key")
    )
    # written out, so that Spark can split the nodes of a bucket that a third of them share when they meet it
    shared = common.checkpoint(bands.groupBy("key").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("blocks"), F.count("*").alias("members")).where("members > 1").drop("members"))
    mates = bands.join(shared, "key").join(nodes.select("node", F.col("low").alias("bytes")), "node")
    dealt = mates.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    met = dealt.select("key", F.least("own", "other").cast("long").alias("i"), F.greatest("own", "other").cast("long").alias("j"), "node", "bytes")
    links = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_links(threshold, tolerance), "a long, b long")
    clusters = components(common.checkpoint(links.distinct())).withColumnRenamed("root", "cluster")
    member = common.checkpoint(clusters.join(nodes, "node"))
    sizes = member.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    large = common.checkpoint(sizes.where("blocks > 1").toDF("large", "blocks"))
    met = common.join_lookup(member, large, member["cluster"] == large["large"], F.xxhash64(member["node"])).withColumn("blocks", F.coalesce("blocks", F.lit(1))).drop("large")
    dealt = met.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    texts = source.join(member.select(F.col("node").alias("id")), "id")
    sets = texts.mapInArrow(_shingles(width), "node long, f1 long, shingles binary")
    paired = (
        dealt.join(sets, ["node", "f1"])
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        .select("cluster", "i", "j", "own", "node", "n", "copies", "sig", "shingles")
        .repartition("cluster", "i", "j")
        .sortWithinPartitions("cluster", "i", "j")
    )
    verified = common.checkpoint(paired.mapInArrow(_verify(threshold, tolerance), "node long, links long, part long"))
    groups = components(verified.where("node <> part").select(F.col("node").alias("a"), F.col("part").alias("b")).distinct())
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    found = classes.join(links, "node", "left").join(groups, "node", "left").where("copies > 1 OR links > 0").select("f1", "f2", F.col("n").alias("n_"), "node", "copies", "links", "root")
    # a class of very many copies is dealt to several tasks, and so are the texts without words
    same = (one["f1"] == found["f1"]) & (one["f2"] == found["f2"]) & (one["n"] == found["n_"])
    out = common.salted_join(one, found, same, F.xxhash64(one["id"])).select(
        F.col("id").alias("doc_id"),
        F.coalesce("root", "node", "id").alias("class_id"),
        F.coalesce("node", "id").alias("copy_of"),
        F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"),
    )
    return out if renamed is None else _by_ids(common.checkpoint(out), renamed)


def _by_ids(out: DataFrame, renamed: DataFrame) -> DataFrame:
    """Rows' numbers replaced by their ids, and class_id by the smallest id of the class."""
    for column in ("doc_id", "copy_of"):
        names = renamed.toDF("row_", "id_")
        joined = common.join_lookup(out, names, out[column] == names["row_"], F.xxhash64(out["doc_id"]))
        out = common.checkpoint(joined.withColumns({"class_of": F.col("class_id") if column == "doc_id" else F.col("class_of"), column: F.coalesce("id_", column)}).drop("row_", "id_"))
    least = common.checkpoint(out.groupBy(F.col("class_of").alias("of_")).agg(F.min("doc_id").alias("least_")).where("of_ <> least_"))
    joined = common.join_lookup(out, least, out["class_of"] == least["of_"], F.xxhash64(out["doc_id"]))
    return joined.select("doc_id", F.coalesce("least_", "class_of").alias("class_id"), "copy_of", "n_links", "n_shingles")
