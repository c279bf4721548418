"""Orders within shared programmes, depth as the fallback, and bases of concepts, on small cases and against brute force."""

from __future__ import annotations

import random

import numpy as np

from quarry.operators import orders, similarity


def admitted(places, course, before):
    shared = {(p, t, u) for c, p, t in places if c == course and t is not None for b, q, u in places if b == before and q == p and u is not None}
    return not shared or any(u < t for _, t, u in shared)


def random_places(draw, n):
    return [(c, draw.choice("pqrs"), draw.choice([None, 1, 2, 3, 4])) for c in range(n) for _ in range(draw.randint(0, 3))]


def test_allowed(spark):
    draw = random.Random(2)
    places = random_places(draw, 40)
    pairs = [(a, b) for a in range(40) for b in range(40) if a != b]
    got = orders.allowed(spark.createDataFrame(pairs, "course long, before long"), spark.createDataFrame([*places, (1, None, 3)], "course long, programme string, term int"))
    assert sorted(map(tuple, got.collect())) == sorted(p for p in pairs if admitted(places, *p))


def test_nearest_by_places_and_depth(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 8)
    monkeypatch.setattr(similarity, "TEAM", 2)
    monkeypatch.setattr(similarity, "AT_ONCE", 3)
    draw, random_ = random.Random(5), np.random.default_rng(5)
    v = random_.normal(size=(60, 4)).round(2)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = np.round(unit @ unit.T, 6)
    places = random_places(draw, 60)
    term = [draw.choice([None, 1.0, 2.0, 3.0]) for _ in range(60)]
    depth = [draw.randrange(4) for _ in range(60)]

    def earlier(a, b):
        return term[b] < term[a] if term[a] is not None and term[b] is not None else depth[b] < depth[a]

    own = [[(p, None if t is None else float(t)) for c, p, t in places if c == i] for i in range(60)]
    rows = [(i, v[i].tolist(), term[i], depth[i], own[i] or None) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, v array<double>, position double, depth long, places array<struct<programme: string, term: double>>")
    for columns, keep in ((["id", "v", "position", "depth"], earlier), (["id", "v", "places"], lambda a, b: admitted(places, a, b))):
        want = []
        for a in range(60):
            ranked = sorted((-cos[a, b], b) for b in range(60) if a != b and cos[a, b] >= 0.1 and keep(a, b))[:3]
            want += [(a, b, -s) for s, b in ranked]
        assert sorted(map(tuple, similarity.nearest_others(df.select(columns), 3, least=0.1).collect())) == sorted(want)


def test_bases(spark, monkeypatch):
    monkeypatch.setattr(orders, "TRIED", 2)
    draw = random.Random(7)
    n = 30
    requires = [(c, draw.choice("uvw"), draw.randint(1, 9) / 10) for c in range(n) for _ in range(2)]
    covers = [(c, draw.choice("uvw"), draw.randint(1, 4) / 10) for c in range(n) for _ in range(2)]
    places, above = random_places(draw, n), {(c, c // 2) for c in range(1, n)} | {(c, c // 4) for c in range(2, n)}
    names = {c: draw.choice(["Ana", "Bob", None]) for c in range(n)}
    terms = {c: draw.choice([None, 1, 2]) for c in range(n)}
    give, need = ({(c, k): max(x for d, j, x in rows if (d, j) == (c, k)) for c, k, _ in rows} for rows in (covers, requires))
    want, merged = [], {}
    for (course, concept), sure in need.items():
        if any((course, a) in above for a, k in give if k == concept):
            continue
        free = [(-give[b, concept], 99 if terms[b] is None else terms[b], names[b] or str(b), b) for b, k in give if k == concept and b != course and admitted(places, course, b)]
        if free:
            merged.setdefault((course, min(free)[3]), []).append((min(sure, -min(free)[0]), concept))
    for course in range(n):
        ranked = sorted((-max(x)[0], names[b] or str(b), b, ",".join(sorted(k for _, k in x))) for (c, b), x in merged.items() if c == course)[:6]
        want += [(course, i + 1, b, -s, k) for i, (s, _, b, k) in enumerate(ranked)]
    got = orders.base_of_concepts(
        spark.createDataFrame(requires, "course long, concept string, conf double"), spark.createDataFrame(covers, "course long, concept string, conf double"),
        spark.createDataFrame(sorted(above), "node long, ancestor long"), spark.createDataFrame(places, "course long, programme string, term int"),
        spark.createDataFrame([(c, names[c], terms[c]) for c in range(n)], "course long, name string, term int"),
    )
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_only_near_pairs_are_looked_at(monkeypatch):
    random_, looked, admitted_ = np.random.default_rng(3), [], similarity._admitted

    def counted(*args):
        out = admitted_(*args)
        looked.append(out.size)
        return out

    monkeypatch.setattr(similarity, "_admitted", counted)
    n, few = 400, similarity.FEW if hasattr(similarity, "FEW") else 0
    v = random_.normal(size=(n, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    cos, ids, none = np.round(v @ v.T, 4), np.arange(n), np.full((2, n), np.nan)
    # one programme of all; a third of the courses are earlier than the others
    term = (ids % 3 > 0).astype(float)
    side = ids, none, v, (np.array([0]), np.array([n + 1])), (ids, np.array(["p"] * n, object), term)
    for least in (0.5, -1.0):
        looked.clear()
        got = list(zip(*similarity._best_others(side, side, 3, 1.0, 0.99, 4, least, False), strict=True))
        want = [(a, b, -s) for a in range(n) for s, b in sorted((-cos[a, b], b) for b in range(n) if a != b and cos[a, b] >= least and term[b] < term[a])[:3]]
        assert sorted(got) == sorted(want)
        # of 160,000 pairs some 1,200 are near by 0.5; where all are, those without any earlier course see all
        assert sum(looked) < (n * n / 50 if least > 0 else n * n / 3 * 1.5 + 2 * n * (few + 2))


def test_more_are_looked_at_where_few_are_admitted(spark, monkeypatch):
    monkeypatch.setattr(similarity, "FEW", 2, raising=False)
    test_nearest_by_places_and_depth(spark, monkeypatch)
