"""Structural and semantic similarity of courses, and the recommendations that follow from them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.lineage import Rounds, checkpoint, shuffled

#: Weights of the parts of a signature; those of parts that neither side has are dealt to the others.
WEIGHTS = {"prereqs": 0.35, "teachers": 0.30, "dependents": 0.20, "co_prereqs": 0.10, "prereqs_2": 0.05}

#: Vectors of a block, blocks that meet another one in a task, and queries scored at once.
BLOCK, TEAM, AT_ONCE = 2048, 16, 64
#: Others of a vector that are looked at first, where many are near enough; each further round looks at eight times as many.
FEW = 64
#: Bases of a concept that are tried in the first round.
TRIED = 16


def signatures(edges: DataFrame, teaches: DataFrame) -> DataFrame:
    """(part, course, item): the five sets of a course as rows: prerequisites, teachers, dependents, fellow prerequisites, prerequisites of those."""
    pairs = edges.select("src", "dst").distinct()
    back = pairs.toDF("far", "src")
    fellow = pairs.toDF("item", "dst").join(shuffled(pairs), "dst").where("item <> src").select(F.col("src").alias("course"), "item").distinct()
    own = pairs.select(F.col("dst").alias("course"), F.col("src").alias("item"))
    sets = {
        "prereqs": own,
        "teachers": teaches.select("course", F.col("teacher").alias("item")),
        "dependents": pairs.select(F.col("src").alias("course"), F.col("dst").alias("item")),
        "co_prereqs": fellow.join(shuffled(own), ["course", "item"], "left_anti"),
        "prereqs_2": pairs.join(shuffled(back), "src").select(F.col("dst").alias("course"), F.col("far").alias("item")).distinct().join(shuffled(own), ["course", "item"], "left_anti"),
    }
    rows = None
    for part, s in sets.items():
        s = s.select(F.lit(part).alias("part"), "course", "item")
        rows = s if rows is None else rows.unionAll(s)
    return rows


def structural(rows: DataFrame, threshold: float = 0.08, most_items: int | None = None) -> DataFrame:
    """(a, b, score): weighted Jaccard of signatures for pairs a < b that share an item and reach the threshold.

    Pairs are found through their shared items: sharing none means 0. most_items leaves out items of more holders from the search for pairs.
    """
    sizes = rows.groupBy("course", "part").agg(F.count("*").alias("n"))
    wide = sizes.groupBy("course").pivot("part", list(WEIGHTS)).agg(F.first("n"))
    wide = wide.select("course", *(F.coalesce(p, F.lit(0)).alias(p) for p in WEIGHTS))
    one, two = rows.toDF("part", "a", "item"), rows.toDF("part", "b", "item")
    common = one.join(shuffled(two), ["part", "item"]).where("a < b").groupBy("a", "b").agg(*(F.count_if(F.col("part") == p).alias(f"c_{p}") for p in WEIGHTS))
    joined = common.join(shuffled(wide.toDF("a", *(f"a_{p}" for p in WEIGHTS))), "a").join(shuffled(wide.toDF("b", *(f"b_{p}" for p in WEIGHTS))), "b")
    gained, weight = F.lit(0.0), F.lit(0.0)
    for p, w in WEIGHTS.items():
        union = F.col(f"a_{p}") + F.col(f"b_{p}") - F.col(f"c_{p}")
        gained = gained + F.when(union > 0, F.lit(w) * F.col(f"c_{p}") / union).otherwise(0.0)
        weight = weight + F.when(union > 0, F.lit(w)).otherwise(0.0)
    return joined.select("a", "b", F.round(gained / weight, 6).alias("score")).where(F.col("score") >= threshold)


def top_similar(pairs: DataFrame, n: int = 5) -> DataFrame:
    """(course, rank, similar, score): the n most similar of each course, both ways."""
    both = pairs.selectExpr("a AS course", "b AS similar", "score").unionAll(pairs.selectExpr("b", "a", "score"))
    rank = F.row_number().over(Window.partitionBy("course").orderBy(F.desc("score"), "similar"))
    return both.withColumn("rank", rank).where(F.col("rank") <= n).select("course", "rank", "similar", "score")


def blend(structure: DataFrame, vectors: DataFrame, threshold: float = 0.08) -> DataFrame:
    """(a, b, score): 0.6 structure + 0.4 cosine for the pairs of `structure`. vectors: (id, v)."""
    va, vb = vectors.toDF("a", "va"), vectors.toDF("b", "vb")
    joined = structure.join(va, "a", "left").join(vb, "b", "left")
    score = F.round(0.6 * F.col("score") + 0.4 * F.coalesce(cosine(F.col("va"), F.col("vb")), F.lit(0.0)), 6)
    return joined.select("a", "b", score.alias("score")).where(F.col("score") >= threshold)


def find_similar(structure: DataFrame, vectors: DataFrame, n: int = 5, threshold: float = 0.08) -> DataFrame:
    """(course, rank, similar, score): the n best others of each course by 0.6 structure + 0.4 cosine, among all pairs.

    structure: all pairs (a, b, score) above 0, without a threshold; vectors: (id, v) of all courses that have one. Pairs without structure score
    0.4 cosine: of those, each course's n best by that score are enough, as structure only raises the others.
    """
    structure = checkpoint(structure)
    near = nearest_others(vectors, n, weight=0.4, least=threshold).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    alone = near.join(structure, ["a", "b"], "left_anti").withColumn("score", F.lit(0.0))
    return top_similar(blend(structure.unionAll(alone), vectors, threshold), n)


def nearest_others(vectors: DataFrame, n: int, weight: float = 1.0, most: float = 1.0, digits: int = 6, least: float = -1.0) -> DataFrame:
    """(id, other, score): the n others of each vector with the highest weight * cosine, up to `most`, rounded, and not below `least`; ties to the smaller id.

    vectors: (id, v), an id a row; with position, only others of a smaller position count, where either has none (null) those of a smaller depth, if that column is there; with places, an array of
    (programme, term), only others that orders.allowed() admits; with tied, an array of ids, pairs of which either names the other don't. Every block of vectors meets every other one as packed rows, in tiles of up to TEAM by TEAM blocks, and n rows a vector and tile leave a task, so
    the work is that of all pairs, but the rows are not.
    """
    ordered, bound, placed = ("position" in vectors.columns, "tied" in vectors.columns, "places" in vectors.columns)
    rows = vectors.where("id is not null and v is not null").select(
        F.col("id").cast("long").alias("id"),
        (F.col("position").cast("double") if ordered else F.lit(0.0)).alias("position"),
        (F.coalesce(F.col("depth").cast("double"), F.lit(float("nan"))) if "depth" in vectors.columns else F.lit(float("nan"))).alias("depth"),
        (F.coalesce("places", F.expr("array()")) if placed else F.expr("array()")).cast("array<struct<programme: string, term: double>>").alias("places"),
        (F.coalesce("tied", F.expr("array()")) if bound else F.expr("array()")).cast("array<long>").alias("tied"),
        (F.col("v") if dict(vectors.dtypes)["v"] == "array<float>" else F.col("v").cast("array<double>")).alias("v"),
    )
    rows = checkpoint(rows)
    blocks = max(1, -(-rows.count() // BLOCK))
    packed = checkpoint(rows.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("id", "position", "depth", "places", "tied", "v")).alias("rows")))
    # teams of blocks on both sides, so that a vector is sent as often as there are teams; small enough for a tile for each partition
    side = math.ceil(math.sqrt(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    size = max(1, min(TEAM, blocks // side))
    each, team = F.explode(F.sequence(F.lit(0), F.lit(-(-blocks // size) - 1))), F.expr(f"block div {size}").cast("int")
    asked = packed.select(team.alias("q"), each.alias("team"), F.lit(True).alias("asked"), "rows")
    data = packed.select(each.alias("q"), team.alias("team"), F.lit(False).alias("asked"), "rows")

    def run(group: pa.Table) -> pa.Table:
        mask = group.column("asked").combine_chunks()
        a, b = (_unpacked(group.filter(m).column("rows")) for m in (mask, pc.invert(mask)))
        found = _best_others(a, b, n, weight, most, digits, least, ordered) if a and b else ([], [], [])
        return pa.table([pa.array(c, t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["id", "other", "score"])

    found = asked.unionAll(data).groupBy("q", "team").applyInArrow(run, "id long, other long, score double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")


def _unpacked(packed: pa.ChunkedArray):
    """(ids, positions and depths, unit vectors, (rows, ids) of the ties, (rows, programmes, terms) of the known places), in the order of ids; None if there are none."""
    if not len(packed):
        return None
    rows = pa.concat_arrays([c.flatten() for c in packed.chunks])
    rows = rows.take(pc.sort_indices(rows.field("id")))
    ids, positions = rows.field("id").to_numpy(), np.stack([rows.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("position", "depth")])
    v = np.nan_to_num(rows.field("v").flatten().to_numpy(zero_copy_only=False).astype(float)).reshape(len(ids), -1)
    size = np.linalg.norm(v, axis=1, keepdims=True)
    tied = rows.field("tied")
    owner = np.repeat(np.arange(len(ids)), tied.value_lengths().to_numpy())
    places = rows.field("places")
    programmes, terms = places.flatten().field("programme"), places.flatten().field("term").to_numpy(zero_copy_only=False).astype(float)
    known = ~np.isnan(terms) & programmes.is_valid().to_numpy(zero_copy_only=False)
    at = np.repeat(np.arange(len(ids)), places.value_lengths().to_numpy())[known], np.array(programmes.to_pylist(), object)[known], terms[known]
    return ids, positions, v / np.where(size > 0, size, 1), (owner, tied.flatten().to_numpy(zero_copy_only=False)), at


def _met(ties: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, places in ids) of the ties whose id is among ids."""
    owner, named = ties
    place = np.searchsorted(ids, named)
    hit = ids[np.minimum(place, len(ids) - 1)] == named
    return owner[hit], place[hit]


def _found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the sorted keys, whether it is there) of each key that is asked for."""
    place = np.minimum(np.searchsorted(keys, asked), max(len(keys) - 1, 0))
    return place, keys[place] == asked if len(keys) else np.zeros(len(asked), bool)


def _later(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether each of a comes after that of b: by position, or by depth where either has no position."""
    (pa_, da), (pb, db) = a, b
    return np.where(np.isnan(pa_) | np.isnan(pb), db < da, pb < pa_)


def _terms(a, b) -> tuple[int, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The number of programmes that both sides have; (row and programme as one sorted key, term) of each side: the latest term of a, the earliest of b."""
    code = {programme: k for k, programme in enumerate(set(a[1]) & set(b[1]))}

    def side(places, better):
        rows, programmes, terms = places
        codes = np.array([code.get(p, -1) for p in programmes], np.int64)
        keys, at = np.unique((rows * len(code) + codes)[codes >= 0], return_inverse=True)
        best = np.full(len(keys), np.inf if better is np.minimum else -np.inf)
        better.at(best, at, terms[codes >= 0])
        return keys, best

    return len(code), side(a, np.maximum), side(b, np.minimum)


def _admitted(terms, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether row j of b may come before row i of a, for each of the pairs, by the terms in programmes that both have."""
    size, (mine, latest), (theirs, earliest) = terms
    if not size:
        return np.ones(len(i), bool)
    low = np.searchsorted(mine, i * size)
    n = np.searchsorted(mine, (i + 1) * size) - low
    pair = np.repeat(np.arange(len(i)), n)
    at = np.arange(len(pair)) + np.repeat(low - np.cumsum(n) + n, n)
    place, hit = _found(theirs, j[pair] * size + mine[at] % size)
    less, comparable = (np.zeros(len(i), bool) for _ in range(2))
    comparable[pair[hit]] = True
    less[pair[hit & (earliest[place] < latest[at])]] = True
    return less | ~comparable


def _best_others(a, b, n: int, weight: float, most: float, digits: int, least: float, ordered: bool):
    """(ids, others, scores): the n best rows of b for each of a.

    Only pairs that are near enough are looked at one by one: all of them where they are few, else the nearest of each row, and more for rows that then lack some.
    """
    (a_ids, a_positions, a_v, a_ties, a_places), (b_ids, b_positions, b_v, b_ties, b_places) = a, b
    named, names = _met(a_ties, b_ids), _met(b_ties, a_ids)[::-1]
    width = len(b_ids)
    barred = np.unique(np.concatenate([named[0], names[0]]) * width + np.concatenate([named[1], names[1]]))
    terms = _terms(a_places, b_places)
    # rounding moves a score by less
    slack, out = 10.0**-digits, []
    for start in range(0, len(a_ids), AT_ONCE):
        rows = np.arange(start, min(start + AT_ONCE, len(a_ids)))
        raw, low = weight * (a_v[rows] @ b_v.T), np.full(len(rows), least - slack)
        k = width if np.count_nonzero(raw >= least - slack) <= FEW * len(rows) else max(FEW, n)
        while len(rows):
            bar = low if k >= width else np.maximum(low, np.minimum(np.partition(raw, -k, axis=1)[:, -k], most) - slack)
            i, j = np.nonzero(raw >= bar[:, None])
            s = np.round(np.minimum(raw[i, j], most), digits)
            for test in (
                lambda i, j, s: (s >= least) & (a_ids[rows[i]] != b_ids[j]),
                lambda i, j, s: _later(a_positions[:, rows[i]], b_positions[:, j]) if ordered else np.ones(len(i), bool),
                lambda i, j, s: _admitted(terms, rows[i], j),
                lambda i, j, s: ~_found(barred, rows[i] * width + j)[1],
            ):
                kept = test(i, j, s)
                i, j, s = i[kept], j[kept], s[kept]
            enough = (np.bincount(i, minlength=len(rows)) >= n) | (bar <= low) | (k >= width)
            order = np.lexsort([j, -s, i])
            i, j, s = i[order], j[order], s[order]
            best = (np.arange(len(i)) - np.searchsorted(i, i) < n) & enough[i]
            out.append((a_ids[rows[i[best]]], b_ids[j[best]], s[best]))
            rows, raw, low, k = rows[~enough], raw[~enough], low[~enough], k * 8
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def predict_missing(similar: DataFrame, edges: DataFrame, threshold: float = 0.4, n: int = 3) -> DataFrame:
    """(course, prereq, share): prerequisites that many of a course's similar ones have and it lacks. similar: (course, similar)."""
    pairs = edges.select(F.col("dst").alias("similar"), F.col("src").alias("prereq")).distinct()
    size = similar.groupBy("course").agg(F.count("*").alias("size"))
    votes = similar.join(shuffled(pairs), "similar").where("prereq <> course").groupBy("course", "prereq").agg(F.count("*").alias("votes"))
    own = edges.select(F.col("dst").alias("course"), F.col("src").alias("prereq")).distinct()
    share = votes.join(shuffled(size), "course").withColumn("share", F.round(F.col("votes") / F.col("size"), 6)).where(F.col("share") >= threshold).join(shuffled(own), ["course", "prereq"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("course").orderBy(F.desc("share"), "prereq"))
    return share.withColumn("rank", rank).where(F.col("rank") <= n).select("course", "prereq", "share", "rank")


def name_jaccard(names: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(a, b, score): distinct names by the Jaccard similarity of their tokens of over two letters, found through shared tokens."""
    sets = names.select("name").distinct().select("name", F.array_distinct(F.filter(F.split(text.graph_key("name"), " "), lambda w: F.length(w) > 2)).alias("t"))
    one = sets.select(F.col("name").alias("a"), F.size("t").alias("na"), F.explode("t").alias("token"))
    two = one.toDF("b", "nb", "token")
    common = one.join(two, "token").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
    return common.select("a", "b", F.round(F.col("c") / (F.col("na") + F.col("nb") - F.col("c")), 6).alias("score")).where(F.col("score") >= threshold)


def recommended_before(vectors: DataFrame, closure: DataFrame, order: DataFrame, threshold: float = 0.65, n: int = 3) -> DataFrame:
    """(course, rank, before, score): earlier, close in meaning, and not tied by prerequisites either way. Each course is compared with all others.

    vectors: (id, v). closure: (node, ancestor). order: (id) with what nearest_others() goes by: position, and depth for pairs of which either has no position; or places.
    """
    tied = closure.groupBy(F.col("node").alias("id")).agg(F.collect_set("ancestor").alias("tied"))
    near = nearest_others(vectors.join(shuffled(order), "id").join(shuffled(tied), "id", "left"), n, most=0.99, digits=4, least=threshold)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "other"))
    return near.select(F.col("id").alias("course"), rank.alias("rank"), F.col("other").alias("before"), "score")


def concept_base(requires: DataFrame, covers: DataFrame, closure: DataFrame, n: int = 6) -> DataFrame:
    """(course, base, confidence, rank): per concept that a course requires, the best course that covers it, unless that is itself, an ancestor or a descendant.

    requires: (course, concept, conf); covers: (course, concept, conf). Bases are ranked once for each concept and need, whatever the number of courses that have it, and tried in that order, some
    more in each round for what is still without one; so a common concept doesn't pair all that require it with all that cover it.
    """
    rounds = Rounds(requires.sparkSession)
    # of a course's needs of a concept, and of a base's shares of it, the highest decides
    left = rounds.keep("left", requires.where("course IS NOT NULL AND concept IS NOT NULL").groupBy("course", "concept").agg(F.max("conf").alias("need")))
    give = rounds.keep("give", covers.where("concept IS NOT NULL").groupBy(F.col("course").alias("base"), "concept").agg(F.max("conf").alias("give")))
    ties = rounds.keep("ties", closure.select(F.col("node").alias("course"), F.col("ancestor").alias("base")))
    both = ties.unionAll(ties.select(F.col("base").alias("course"), F.col("course").alias("base")))
    scored, tried, most, parts = left.where("false").select("course", "concept", F.lit(None).cast(give.schema["base"].dataType).alias("base"), F.lit(None).cast("double").alias("confidence")), 0, TRIED, 0
    while not left.isEmpty():
        by = F.row_number().over(Window.partitionBy("concept", "need").orderBy(F.desc("confidence"), "base"))
        rated = left.select("concept", "need").distinct().join(give, "concept").select("concept", "need", "base", F.least("need", "give").alias("confidence"))
        ranked = rounds.keep("ranked", rated.withColumn("r", by).where(F.col("r") <= most))
        pairs = left.join(ranked.where(F.col("r") > tried), ["concept", "need"]).where("course <> base").join(shuffled(both), ["course", "base"], "left_anti")
        top = pairs.groupBy("course", "concept").agg(F.min_by(F.struct("base", "confidence"), "r").alias("t")).select("course", "concept", "t.base", F.col("t.confidence").cast("double").alias("confidence"))
        found, parts = rounds.keep(f"found{parts}", top), parts + 1
        scored = scored.unionAll(found)
        more = ranked.where(F.col("r") == most).select("concept", "need")
        left = rounds.keep("left", left.join(more, ["concept", "need"], "left_semi").join(found, ["course", "concept"], "left_anti"))
        tried, most = most, most * 8
    best = checkpoint(scored.groupBy("course", "base").agg(F.max("confidence").alias("confidence")))
    rounds.done()
    rank = F.row_number().over(Window.partitionBy("course").orderBy(F.desc("confidence"), "base"))
    return best.withColumn("rank", rank).where(F.col("rank") <= n)
