"""Depths of nodes and of graphs kept apart, against brute force, on odd rows too; a result takes one shuffle of what the rounds found."""

from __future__ import annotations

import random

from quarry.operators import audit, closure


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def brute(edges, nodes):
    """The longest path to each node that is on no cycle and behind none."""
    before, found = {n: set() for n in nodes}, {}
    for src, dst in edges:
        before.setdefault(src, set())
        before.setdefault(dst, set()).add(src)
    while ready := [n for n in before if n not in found and before[n] <= found.keys()]:
        found |= {n: 1 + max((found[b] for b in before[n]), default=-1) for n in ready}
    return found


def test_random_graphs(spark):
    draw = random.Random(11)
    for cycles in (False, True):
        edges = [(a, b) if cycles or a < b else (b, a) for a, b in ((draw.randrange(40), draw.randrange(40)) for _ in range(35)) if cycles or a != b]
        edges += edges[:9]
        nodes = [50, 51, 51, 3]
        df, ends = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(n,) for n in nodes], "node long")
        got = closure.depths(df, ends)
        assert got.columns == ["node", "depth"] and got.dtypes[1] == ("depth", "int")
        assert sorted(map(tuple, got.collect())) == sorted(brute(edges, nodes).items())


def test_students_against_brute_force(spark):
    draw = random.Random(12)
    needs = [(draw.randrange(12), draw.randrange(12)) for _ in range(22)]
    needs += [(1, 2), (2, 1), (5, 5), (None, 3), (3, None)] + needs[:5]
    pending = [(draw.randrange(40), draw.randrange(14)) for _ in range(300)] + [(None, 3), (None, 2), (77, None), (None, None), (78, 1), (78, 2), (79, 5), (80, 5), (80, 13)]
    pending += pending[:50]
    got = audit.pending_semesters(spark.createDataFrame(pending, "student int, course long"), spark.createDataFrame(needs, "src long, dst long"))
    want = {}
    for s in {s for s, _ in pending}:
        own = {c for t, c in pending if t == s}
        # a student without a number, or a course without, meets nothing
        inner = [(a, b) for a, b in needs if s is not None and a is not None and b is not None and {a, b} <= own]
        if depth := brute(inner, own):
            want[s] = 1 + max(depth.values())
    assert 78 not in want and 79 not in want and want[80] == 1 and want[None] == 1 and max(want.values()) > 2
    assert got.dtypes == [("student", "int"), ("semesters", "int")]
    assert {r.student: r.semesters for r in got.collect()} == want and got.count() == len(want)


def test_no_rows(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert closure.depths(none).collect() == []
    assert [tuple(r) for r in closure.depths(none, spark.createDataFrame([(4,), (None,)], "node long")).orderBy("node").collect()] == [(None, 0), (4, 0)]
    assert audit.pending_semesters(spark.createDataFrame([], "student long, course long"), none).collect() == []


def test_what_rounds_found_is_shuffled_once(spark):
    needs = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "src long, dst long")
    assert exchanges(closure.depths(needs)) == 1
    pending = spark.createDataFrame([(s, c) for s in range(5) for c in (1, 2, 3)], "student long, course long")
    assert exchanges(audit.pending_semesters(pending, needs)) == 1
