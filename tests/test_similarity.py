"""Similar and recommended courses against brute force over all pairs."""

from __future__ import annotations

import duckdb
import numpy as np

from quarry import catalog, tables
from quarry.operators import closure, similarity

SMALL = "/root/testdata/sf0.001"
WEIGHTS = similarity.WEIGHTS


def cosines(v):
    v = np.array(v, float)
    size = np.linalg.norm(v, axis=1, keepdims=True)
    v = v / np.where(size > 0, size, 1)
    return v @ v.T


def best(scores, n):
    """{(id, rank, other, score)} of {id: {other: score}}."""
    return {(a, r, b, s) for a, row in scores.items() for r, (s, b) in enumerate(sorted(((s, b) for b, s in row.items()), key=lambda x: (-x[0], x[1]))[:n], 1)}


def vectors_of(con):
    return con.execute(f"SELECT vec_id, embedding FROM '{SMALL}/embeddings.parquet' JOIN '{SMALL}/part.parquet' ON p_partkey = vec_id ORDER BY 1").fetchall()


def test_find_similar_scores_all_pairs(spark):
    sets = {}
    for part, course, item in similarity.signatures(tables.prerequisites(spark, SMALL), tables.teaches(spark, SMALL)).collect():
        sets.setdefault((part, course), set()).add(item)
    rows = vectors_of(duckdb.connect())
    cos, at = cosines([v for _, v in rows]), {i: k for k, (i, _) in enumerate(rows)}
    courses = sorted({c for _, c in sets} | set(at))
    scores = {a: {} for a in courses}
    alone = 0
    for a in courses:
        for b in courses:
            x = {p: (sets.get((p, a), set()), sets.get((p, b), set())) for p in WEIGHTS}
            weight = sum(w for p, w in WEIGHTS.items() if x[p][0] | x[p][1])
            structure = round(sum(w * len(x[p][0] & x[p][1]) / len(x[p][0] | x[p][1]) for p, w in WEIGHTS.items() if x[p][0] | x[p][1]) / weight, 6) if weight else 0.0
            score = round(0.6 * structure + 0.4 * (cos[at[a], at[b]] if a in at and b in at else 0.0), 6)
            if a != b and score >= 0.08:
                scores[a][b] = score
                alone += structure < 0.08
    got = {(r["course"], r["rank"], r["similar"], r["score"]) for r in catalog.queries()["find_similar"](spark, SMALL).collect()}
    assert alone and got == best(scores, 5)


def test_pairs_of_little_or_no_structure(spark):
    structure = spark.createDataFrame([(1, 2, 0.05), (1, 3, 0.5)], "a long, b long, score double")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.75**0.5]), (4, [1.0, 0.1]), (5, [0.0, 0.0]), (6, None)], "id long, v array<float>")
    got = {r["similar"]: r["score"] for r in similarity.find_similar(structure, vectors).where("course = 1").collect()}
    assert got == {3: 0.3, 2: 0.23, 4: round(0.4 / 1.01**0.5, 6)}


def test_recommended_before_compares_all_pairs(spark):
    con = duckdb.connect()
    rows = vectors_of(con)
    term = dict(con.execute(f"SELECT p_partkey, 1 + p_size % 10 FROM '{SMALL}/part.parquet'").fetchall())
    tied = {(r["node"], r["ancestor"]) for r in closure.ancestors(tables.prerequisites(spark, SMALL)).collect()}
    cos = np.round(np.minimum(cosines([v for _, v in rows]), 0.99), 4)
    ids = [i for i, _ in rows]
    free = lambda a, b: term[b] < term[a] and (a, b) not in tied and (b, a) not in tied
    scores = {a: {b: float(cos[k, m]) for m, b in enumerate(ids) if cos[k, m] >= 0.3 and free(a, b)} for k, a in enumerate(ids)}
    got = {(r["course"], r["rank"], r["before"], r["score"]) for r in catalog.queries()["recommended_before"](spark, SMALL).collect()}
    assert got and got == best(scores, 3)


def test_nearest_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 8)
    monkeypatch.setattr(similarity, "TEAM", 2)
    draw = np.random.default_rng(3)
    v = draw.normal(size=(120, 4)).round(1)
    v[40:70] = v[40]  # a large group of equal vectors: ties by id
    tied = {i: [int(x) for x in draw.integers(0, 120, 3)] for i in range(0, 120, 2)}
    rows = [(i, float(i % 7), tied.get(i), v[i].tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, position double, tied array<long>, v array<double>")
    cos = np.round(0.4 * cosines(v), 6)
    bars = {frozenset((i, j)) for i, t in tied.items() for j in t}
    for columns, keep in ((["id", "v"], lambda a, b: True), (["id", "position", "tied", "v"], lambda a, b: b % 7 < a % 7 and frozenset((a, b)) not in bars)):
        scores = {a: {b: float(cos[a, b]) for b in range(120) if a != b and cos[a, b] >= 0.05 and keep(a, b)} for a in range(120)}
        got = [tuple(r) for r in similarity.nearest_others(df.select(columns), 4, weight=0.4, least=0.05).collect()]
        assert sorted(got) == sorted((a, b, s) for a, _, b, s in best(scores, 4))
    assert similarity.nearest_others(df.limit(0), 4).collect() == []
