"""Exact top-k search by inner product: no-random-access aggregation (NRA; Fagin, Lotem and Naor 2001).

Vectors are dealt into blocks; each (query block, vector block) pair is a task. It holds one list of
the block's vectors per dimension, sorted by that component. For a query, a list is read from its high
end where the query's component is positive and from its low end where it is negative, so the
contributions in every list fall. Reading goes on in steps that triple. After each step every vector has a lower bound
(what was read of it) plus an upper bound (for each list where it was not read, at most the list's
last contribution). A query stops when no outsider's upper bound reaches the k-th best lower bound; then the final
scores of the vectors that can still be among the best are resolved. Each task returns k rows per query at most, and a
window over these picks the k best of all blocks.

Contributions may be negative, so a lower bound needs the list's other end: what is unread of a vector is at
least the list's lowest contribution.

Scores are exact integers: products of doubles where all sums stay below 2**52, of 64-bit integers up to 2**62, of Python's integers beyond. Bounds are
doubles; where they may be rounded, they are widened by more than the rounding. A score that does not fit a long raises.

Defined results: vectors that are null, empty, or hold null, non-finite or (once scaled) infinite components take no part; null ids take no part; only vectors of
a query's own length are its candidates; every row is one, rows that share a vec_id too, but for the query's own row; each row that asks is answered by itself;
ties go to the smaller vec_id; a query has fewer than k rows if there are fewer candidates; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Vectors and queries of one task at most, the components of either (8 MB as doubles; a task holds some ten such matrices), and queries that are answered at once.
VECTOR_BLOCK, QUERY_BLOCK, CELLS, AT_ONCE = 16384, 16384, 1 << 20, 128
FIRST_STEP = 64


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of rows of integers, held as doubles, with one of them."""
    most = np.abs(vectors).max(axis=0, initial=0) @ np.abs(query)
    if most < 2.0**52:
        return (vectors @ query).astype(np.int64)
    if most < 2.0**62:
        return vectors.astype(np.int64) @ query.astype(np.int64)
    whole = list(map(int, query))
    return np.array([sum(int(x) * y for x, y in zip(v, whole, strict=True)) for v in vectors], np.int64)


def nra(vectors: np.ndarray, queries: np.ndarray, ids: np.ndarray, mine: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, indexes, scores) of the k best vectors of one block for each query; ids ascend; mine: each query's own vector, or -1.

    What is read of the lists is the same for all queries that are still open, so a step's bounds are products: of each query's
    positive and negative part with the components read from the high and the low ends, or the bounds that stand in for unread ones.
    """
    n = len(vectors)
    values, asked = vectors.astype(np.float64), queries.astype(np.float64)
    order = np.argsort(vectors, axis=0, kind="stable")
    lists = np.take_along_axis(values, order, axis=0)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(n)[:, None], axis=0)
    sums = np.abs(asked) @ np.abs(values).max(axis=0)
    slack = np.where(sums < 2.0**52, 0.0, sums * 2.0**-40)
    active, read, step = np.arange(len(asked)), 0, FIRST_STEP
    while len(active):
        read, step = min(read + step, n), step * 3
        from_high, from_low = place >= n - read, place < read
        upper_high, upper_low = np.where(from_high, values, lists[n - read]).T, np.where(from_low, values, lists[read - 1]).T
        lower_high, lower_low = np.where(from_high, values, lists[0]).T, np.where(from_low, values, lists[-1]).T
        still = []
        for at in range(0, len(active), AT_ONCE):
            some = active[at : at + AT_ONCE]
            up, down = np.maximum(asked[some], 0), np.minimum(asked[some], 0)
            upper = up @ upper_high + down @ upper_low
            lower = up @ lower_high + down @ lower_low if read < n else upper.copy()
            upper, lower = upper + slack[some, None], lower - slack[some, None]
            theirs = np.flatnonzero(mine[some] >= 0)
            upper[theirs, mine[some[theirs]]] = lower[theirs, mine[some[theirs]]] = -np.inf
            bound = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(some), -np.inf)
            can = (upper >= bound[:, None]) & (upper > -np.inf)
            open_ = (can.sum(axis=1) > 4 * k) & (read < n)
            still.append(some[open_])
            for row in np.flatnonzero(~open_):
                who = np.flatnonzero(can[row])
                scores = exact(values[who], asked[some[row]])
                best = np.lexsort((ids[who], -scores))[:k]
                yield int(some[row]), who[best], scores[best]
        active = np.concatenate(still)


def _search(k: int, scale: int):
    schema = pa.schema([(c, pa.int64()) for c in ("row", "query_id", "vec_id", "score")])

    def run(group: pa.Table) -> pa.Table:
        is_query = group.column("is_query").to_numpy()
        ids, rows = group.column("id").to_numpy(), group.column("row").to_numpy()
        values = np.floor(scale * group.column("vector").combine_chunks().flatten().to_numpy()).reshape(len(ids), -1)
        at = np.flatnonzero(~is_query)
        at = at[np.lexsort((rows[at], ids[at]))]
        asks = np.flatnonzero(is_query)
        out = []
        if len(at) and len(asks):
            by_row = np.argsort(rows[at])
            mine = np.minimum(np.searchsorted(rows[at], rows[asks], sorter=by_row), len(at) - 1)
            mine = np.where(rows[at][by_row[mine]] == rows[asks], by_row[mine], -1)
            for a, which, scores in nra(values[at], values[asks], ids[at], mine, k):
                out += [(int(rows[asks[a]]), int(ids[asks[a]]), int(ids[at[i]]), int(s)) for i, s in zip(which, scores, strict=True)]
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 4)], schema=schema)

    return run


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row with is_query, the k other rows of the highest inner products of floor(scale * x)."""
    usable = f"""{id_col} IS NOT NULL AND size({vector_col}) > 0
        AND forall({vector_col}, x -> x IS NOT NULL AND NOT isnan(x) AND abs({scale} * double(x)) < double('infinity'))"""
    chosen = vectors.where(usable).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"),
        F.col(vector_col).cast("array<double>").alias("vector"), F.size(vector_col).alias("dims"),
    )
    chosen = common.checkpoint(chosen)  # row numbers hold from here on
    count, asked, widest = chosen.agg(F.count("*"), F.count_if("is_query"), F.max("dims")).first()
    vectors_each, queries_each = (max(1, min(most, CELLS // (widest or 1))) for most in (VECTOR_BLOCK, QUERY_BLOCK))
    cores = chosen.sparkSession.sparkContext.defaultParallelism
    v_blocks = max(-(-count // vectors_each), min(2 * cores, -(-count // 1024)), 1)
    q_blocks = max(-(-asked // queries_each), 1)

    def each(n: int, name: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    own = F.pmod(F.xxhash64("row"), F.lit(v_blocks)).cast("int").alias("v_block"), F.pmod(F.xxhash64("row"), F.lit(q_blocks)).cast("int").alias("q_block")
    parts = chosen.select("row", "id", F.lit(False).alias("is_query"), "vector", "dims", own[0], each(q_blocks, "q_block")).unionAll(
        chosen.where("is_query").select("row", "id", "is_query", "vector", "dims", each(v_blocks, "v_block"), own[1])
    )
    found = parts.groupBy("dims", "v_block", "q_block").applyInArrow(_search(k, scale), "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
