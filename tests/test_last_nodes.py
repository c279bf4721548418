"""What failing a course blocks: courses that lead to none stay out of the rounds that tell levels apart, beside cycles and odd rows too."""

from __future__ import annotations

import random

import pytest

from quarry.operators import closure


def brute(edges):
    """(node, direct, transitive, depth, critical) by a search from each node."""
    after, out = {}, set()
    for a, b in edges:
        if a is not None:
            after.setdefault(a, set()).add(b)
    for a in after:
        hops, front, n = {}, {a}, 0
        while front:
            n += 1
            front = {b for x in front if x is not None for b in after.get(x, ())} - hops.keys()
            hops |= dict.fromkeys(front, n)
        direct = sum(h == 1 for h in hops.values())
        out.add((a, direct, len(hops), max(hops.values()), direct >= 2))
    return out


def impact(spark, edges, kind="long"):
    frame = spark.createDataFrame([(a, b, 1.0) for a, b in edges], f"src {kind}, dst {kind}, conf double")
    return sorted(map(tuple, closure.failure_impact(frame).collect()))


@pytest.mark.parametrize("cycles", [(), ((70, 71), (71, 70), (71, 72), (72, 5), (90, 90)), ((60, 60), (61, 60), (60, 62), (61, 62), (59, 61), (59, 62))])
def test_against_brute_force(spark, cycles):
    draw = random.Random(13)
    edges = sorted({(a, b) for a, b in ((draw.randrange(30), draw.randrange(30)) for _ in range(40)) if a < b}) + list(cycles)
    assert impact(spark, edges + edges[:7]) == sorted(brute(edges))


def test_only_cycles_one_edge_and_no_rows(spark):
    # 3 leads into the cycle only, and so has no edge of its own level by level
    edges = [(1, 2), (2, 1), (3, 1), (2, 4)]
    assert impact(spark, edges) == sorted(brute(edges))
    assert impact(spark, [(8, 9)]) == [(8, 1, 1, 1, False)]
    assert impact(spark, []) == []


def test_names_and_nulls(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("a", "b"), ("c", None)]
    # what has no name is never found again, so each path to it counts
    assert impact(spark, edges, "string") == [("a", 2, 4, 3, True), ("b", 1, 2, 2, False), ("c", 1, 1, 1, False)]


def test_last_nodes_are_not_in_the_rounds(spark, monkeypatch):
    seen, depths = [], closure.depths
    monkeypatch.setattr(closure, "depths", lambda edges, nodes=None: seen.append(edges.count()) or depths(edges, nodes))
    edges = spark.range(2, 2000).selectExpr("explode(array_distinct(array(id div 2, id div 3))) AS src", "id AS dst", "1.0D AS conf").where("src > 0")
    assert closure.failure_impact(edges).count() == 999
    leading = edges.where("dst < 1000").count()
    assert seen == [leading] and leading < edges.count() * 0.6
