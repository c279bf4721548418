"""Closures by levels: packed rows of bounded size, each made once."""

from __future__ import annotations

import random

import pytest

from quarry.operators import carried, closure


def brute(edges):
    """hops and bound of all pairs, by rounds over plain dictionaries."""
    hops, bound = {}, {}
    for a, b, c in edges:
        hops[a, b], bound[a, b] = 1, max(c, bound.get((a, b), 0))
    direct, n = dict(bound), None
    while n != (dict(hops), dict(bound)):
        n = dict(hops), dict(bound)
        for (a, b), c in direct.items():
            for (x, y), h in n[0].items():
                if x == b:
                    hops[a, y] = min(h + 1, hops.get((a, y), h + 1))
                    bound[a, y] = max(min(c, n[1][x, y]), bound.get((a, y), 0))
    return hops, bound


@pytest.mark.parametrize("sizes", [(1024, 1024, 1 << 21), (3, 2, 5)])
def test_closures_by_levels(spark, monkeypatch, sizes):
    for name, n in zip(("ROW", "EDGES", "HELD"), sizes):
        monkeypatch.setattr(carried, name, n)
    draw = random.Random(11)
    # two hubs with many before and after them, a cycle and what lies behind it
    edges = {(a, b) for a, b in ((draw.randrange(45), draw.randrange(45)) for _ in range(70)) if a < b} | {(i, 50) for i in range(20)} | {(50, i) for i in range(51, 60)}
    edges |= {(70, 71), (71, 72), (72, 70), (72, 80), (80, 81), (3, 71), (50, 81), (90, 90), (-7, 50)}
    edges = sorted((a, b, draw.randrange(1, 9) / 8) for a, b in edges)
    edges += [(edges[0][0], edges[0][1], 0.95)]
    hops, bound = brute(edges)
    frame = spark.createDataFrame(edges, "src long, dst int, conf double")
    got = closure.ancestors(frame).collect()
    assert {(r.ancestor, r.node): r.hops for r in got} == hops and len(got) == len(hops)
    got = closure.bottleneck(frame)
    assert got.schema["dst"].dataType.simpleString() == "int"
    got = got.collect()
    assert {(r.src, r.dst): r.bound for r in got} == bound and len(got) == len(bound)


def test_nulls_and_names(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 0.5)], "src string, dst string, conf double")
    assert {tuple(r) for r in closure.ancestors(edges).collect()} == {("b", "a", 1), ("c", "b", 1), ("c", "a", 2)}
    edges = spark.createDataFrame([(1, 2, None), (2, 3, 0.5)], "src long, dst long, conf double")
    assert {tuple(r) for r in closure.bottleneck(edges).collect()} == {(1, 2, None), (2, 3, 0.5), (1, 3, 0.5)}
    assert closure.ancestors(edges.where("false")).count() == 0


def test_pairs_are_not_shuffled(spark, monkeypatch):
    # 51,003 pairs in 11 levels: what was found in one level is not met again in the next
    kept, checkpoint = [], closure.checkpoint
    monkeypatch.setattr(closure, "checkpoint", lambda df: kept.append(df.columns) or checkpoint(df))
    edges = spark.range(2, 2000).selectExpr("explode(array_distinct(array(id div 2, id div 3))) AS src", "id AS dst").where("src > 0")
    out = closure.descendants(edges)
    assert out.count() == 51003 and not any("hops" in columns for columns in kept)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(src" not in plan and "SortMergeJoin" not in plan


def test_inherited_items(spark, monkeypatch):
    draw = random.Random(4)
    edges = {(a, b) for a, b in ((draw.randrange(40), draw.randrange(40)) for _ in range(60)) if a < b} | {(50, 51), (51, 50), (51, 52), (7, 50)}
    own = {(n, draw.randrange(8)) for n in [*range(40), 50, 52] for _ in range(2)}
    hops, _ = brute([(a, b, 1.0) for a, b in edges])
    above = {}
    for a, b in hops:
        above.setdefault(b, set()).update(i for n, i in own if n == a)
    wanted = {(n, draw.choice([None, *range(8)])) for n in [*range(0, 40, 3), 51, 52, 99]}
    pairs, kept = [], closure._pairs
    monkeypatch.setattr(closure, "_pairs", lambda edges, rounds, ends=None: pairs.append(ends) or kept(edges, rounds, ends))
    frame = lambda rows, names: spark.createDataFrame(list(rows), f"{names[0]} long, {names[1]} long")
    got = {tuple(r) for r in closure.inherited(frame(edges, ("src", "dst")), frame(own, ("node", "item")), frame(wanted, ("node", "item"))).collect()}
    asked = {n for n, _ in wanted}
    assert all(i in above[n] and n in asked for n, i in got)
    assert got >= {(n, i) for n, i in wanted if i in above.get(n, ())} and {n for n, _ in got} == {n for n in asked if above.get(n)}
    # only what is on a cycle or behind one is followed pair by pair
    assert len(pairs) == 1 and {r[0] for r in pairs[0].collect()} == {50, 51, 52}
