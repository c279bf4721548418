"""Joins that grow with the tables aren't broadcast, also where the tables are small."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from quarry import catalog
from quarry.operators import audit, closure, retrieval
from quarry.workload import texts

SMALL = "/root/testdata/sf0.001"


def test_no_broadcast_of_signatures(spark):
    plan = catalog.queries()["enrichment_notes"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_no_broadcast_of_bounds(spark):
    plan = catalog.queries()["path_confidence"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_pairs_of_queries_and_documents_are_no_rows(spark):
    for name in ("bm25_topk", "keyword_weighted_topk", "regulation_keyword_score"):
        plan = catalog.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\(query#\w+, (doc|id)#", plan), name


def test_best_sums_in_small_blocks(spark, monkeypatch):
    for name, n in (("DOCS", 7), ("QUERIES", 3), ("CELLS", 5)):
        monkeypatch.setattr(retrieval, name, n)
    draw = random.Random(3)
    share = {(d, draw.choice("abcdef")): draw.randrange(-2, 4) / 2 for d in range(60) for _ in range(2)}
    weight = {(f"q{q}", draw.choice("abcdefg")): draw.randrange(1, 4) / 2 for q in range(11) for _ in range(2)}
    sums = defaultdict(Counter)
    for (q, t), w in weight.items():
        for (d, u), x in share.items():
            if t == u:
                sums[q][d] += w * x
    postings = spark.createDataFrame([(d, t, x) for (d, t), x in share.items()] + [(None, "a", 9.0)], "doc long, term string, share double")
    asked = spark.createDataFrame([(q, t, w) for (q, t), w in weight.items()], "query string, term string, weight double")
    for least in (None, 0.5):
        want = {(q, r, d, s) for q, c in sums.items() for r, (d, s) in enumerate(sorted(((d, s) for d, s in c.items() if least is None or s >= least), key=lambda p: (-p[1], p[0]))[:4], 1)}
        assert set(map(tuple, retrieval.best_sums(postings, asked, postings.select("doc").distinct(), 4, least).collect())) == want


def test_best_documents_are_found_once(spark, monkeypatch):
    kept, checkpoint = [], texts.checkpoint
    monkeypatch.setattr(texts, "checkpoint", lambda df: kept.append(df.columns) or checkpoint(df))
    plan = texts.lateral_lookup(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert kept[0] == ["query", "doc"] and "parquet" not in plan


def test_depths_carry_no_isolated_nodes(spark, monkeypatch):
    sizes, checkpoint = [], closure.checkpoint
    monkeypatch.setattr(closure, "checkpoint", lambda df: sizes.append((out := checkpoint(df)).count()) or out)
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (7, 8), (8, 7), (8, 9)], "src long, dst long")
    nodes = spark.range(1, 101).withColumnRenamed("id", "node")
    got = {r.node: r.depth for r in closure.depths(edges, nodes).collect()}
    assert got == {n: {2: 1, 3: 2, 4: 3}.get(n, 0) for n in range(1, 101) if n not in (7, 8, 9)}
    assert max(sizes) <= 7


def test_plans_of_students_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(audit, "COURSES", 3)
    courses = spark.createDataFrame([(c, "AB"[c % 2]) for c in range(1, 21)], "course long, programme string")
    needs = spark.createDataFrame([(1, 3), (1, 5), (3, 5), (5, 7), (2, 4), (2, 3)], "src long, dst long")
    own = spark.createDataFrame([(s, "AB"[s % 2]) for s in range(1, 41)], "student long, programme string")
    taken = spark.createDataFrame([(1, 1), (1, 4), (1, 99), (2, 2), (3, 3), (3, 5), (50, 1)], "student long, course long")
    out = audit.progress_detail(taken, own, courses, needs)
    got = {(r.student, r.course): (r.status, r.missing) for r in out.collect()}
    assert out.count() == len(got) == 40 * 10 + 3
    assert [got[1, c] for c in (1, 3, 5, 7, 9, 4, 99)] == [("done", ""), ("available", ""), ("blocked", "3"), ("blocked", "5"), ("available", ""), ("elective", ""), ("unknown", "")]
    assert [got[3, c] for c in (1, 3, 5, 7)] == [("available", ""), ("done", ""), ("done", ""), ("available", "")] and got[50, 1] == ("elective", "")
    assert [got[5, c] for c in (1, 3, 5, 7)] == [("available", ""), ("blocked", "1"), ("blocked", "1,3"), ("blocked", "5")] and got[2, 4] == ("available", "") and got[4, 4] == ("blocked", "2")
    # the rows of students and courses go out as they are made: nothing above the generator that makes them shuffles
    lines = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    deep = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(i for i, line in enumerate(lines) if "Generate explode(filter" in line)
    above = [line for i, line in enumerate(lines[:at]) if deep(line) < min(map(deep, lines[i + 1 : at + 1]))]
    assert above and not any("Join" in line or "Aggregate" in line for line in above)
