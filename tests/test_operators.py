"""Golden values, invariants and brute force for operators."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
from pyspark.sql import functions as F

from quarry import tables
from quarry.functions import text
from quarry.operators import audit, closure, graph, retrieval, routing, validation
from quarry.plans import sync

SMALL = "/root/testdata/sf0.001"


def test_weighted_means(spark):
    lines = spark.createDataFrame([(1, 8.0, 4.0), (1, 7.0, 4.0), (1, 4.8, 4.0), (1, None, 4.0), (1, 9.0, 0.0)], "student long, grade double, credits double")
    assert audit.weighted_mean(lines).first()["gpa"] == 6.6
    more = spark.createDataFrame([(1, 10.0, 4.0)], "student long, grade double, credits double")
    assert audit.what_if(lines, more).first()["gpa"] == 7.45
    assert audit.grade_needed(lines, 8.0, 7.5).first()["needed"] == 8.85
    two = spark.createDataFrame([(1, 8.0, 4.0), (1, 8.0, 4.0)], "student long, grade double, credits double")
    assert audit.what_if(lines, two).first()["gpa"] == 7.16


def test_activity_caps(spark):
    rows = spark.createDataFrame([(1, "a", 60.0), (1, "b", 40.0), (1, "c", 80.0), (1, "one", 200.0)], "student long, kind string, hours double").withColumn("axis", F.col("kind"))
    rules = spark.createDataFrame([("a", 0.6, 40.0), ("b", 0.45, 40.0), ("c", 0.6, 36.0)], "kind string, factor double, ceiling double")
    assert {r["kind"]: r["hours"] for r in audit.capped_hours(rows, rules).collect()} == {"a": 36.0, "b": 18.0, "c": 36.0}
    got = audit.axis_audit(rows.where("axis = 'one'"), {"one": 104.0, "two": 50.0}, 1.0, 150.0).first()
    assert (got["hours"], got["missing_axes"], got["missing_hours"]) == (104.0, 1, 46.0)


def test_bottleneck_of_a_chain(spark):
    edges = spark.createDataFrame([("A", "B", 1.0), ("B", "C", 0.7), ("C", "D", 1.0), ("A", "D", 0.2)], "src string, dst string, conf double")
    got = {(r["src"], r["dst"]): r["bound"] for r in closure.bottleneck(edges).collect()}
    assert got["A", "D"] == 0.7 and got["C", "D"] == 1.0


def test_closures_on_random_graphs(spark):
    draw = random.Random(5)
    pairs = {(draw.randrange(12), draw.randrange(12)) for _ in range(22)}
    pairs = {(a, b) for a, b in pairs if a < b} | {(12, 13), (13, 12)}  # with a cycle
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, conf double")
    hops = {p: 1 for p in pairs}
    for _ in range(20):
        for (a, b), (c, d) in itertools.product(list(hops), pairs):
            if b == c and hops.get((a, d), math.inf) > hops[a, b] + 1:
                hops[a, d] = hops[a, b] + 1
    assert {(r["ancestor"], r["node"]): r["hops"] for r in closure.ancestors(edges).collect()} == hops
    depth = {r["node"]: r["depth"] for r in closure.depths(edges).collect()}
    assert 12 not in depth and 13 not in depth
    assert all(depth[b] > depth[a] for a, b in pairs if a in depth and b in depth)


def test_fixpoints_end_by_themselves(spark, monkeypatch):
    monkeypatch.setattr(closure, "MAX_ROUNDS", 0, raising=False)
    monkeypatch.setattr(closure, "TOGETHER", 3, raising=False)
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(7)], "src long, dst long, conf double")
    pairs = {(a, b) for a in range(8) for b in range(a + 1, 8)}
    assert {(r["ancestor"], r["node"], r["hops"]) for r in closure.ancestors(edges).collect()} == {(a, b, b - a) for a, b in pairs}
    assert {(r["src"], r["dst"]) for r in closure.bottleneck(edges).collect()} == pairs
    assert {(r["node"], r["depth"]) for r in closure.depths(edges).collect()} == {(i, i) for i in range(8)}


def test_rank_fusion(spark):
    lists = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3)], "query long, doc long, rank int"), spark.createDataFrame([(1, 3, 1), (1, 4, 2), (1, 1, 3)], "query long, doc long, rank int")
    got = retrieval.fuse(*lists, n=3).orderBy("rank").collect()
    assert got[0]["doc"] in (1, 3) and len(got) == 3


def test_mmr_by_brute_force(spark):
    draw = np.random.default_rng(1)
    v = draw.normal(size=(15, 6))
    score = [float(x) for x in draw.random(15)]
    rows = [(7, i, score[i], [float(x) for x in v[i]]) for i in range(15)]
    got = [r["doc"] for r in retrieval.mmr(spark.createDataFrame(rows, "query long, doc long, score double, v array<double>"), 6).orderBy("position").collect()]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    chosen = []
    while len(chosen) < 6:
        value = {i: 0.7 * score[i] - 0.3 * max((float(unit[i] @ unit[j]) for j in chosen), default=0.0) for i in range(15) if i not in chosen}
        chosen.append(max(value, key=value.get))
    assert got == chosen


def small_curriculum(spark):
    pending = [(1, c, credits, term) for c, credits, term in ((1, 4, 1), (2, 4, 1), (3, 4, 2), (4, 4, 2), (5, 4, 3), (6, 4, 4))]
    needs = [(1, 3), (2, 4), (3, 5), (4, 6), (5, 6)]
    return spark.createDataFrame(pending, "student long, course long, credits int, term int"), spark.createDataFrame(needs, "src long, dst long")


def test_planner_invariants(spark):
    pending, needs = small_curriculum(spark)
    rows = audit.plan_semesters(pending, needs, 8).collect()
    when = {r["course"]: r["semester"] for r in rows}
    assert set(when) == {1, 2, 3, 4, 5, 6}
    assert all(when[a] < when[b] for a, b in [(1, 3), (2, 4), (3, 5), (4, 6), (5, 6)])
    used = {}
    for r in rows:
        used[r["semester"]] = used.get(r["semester"], 0) + r["credits"]
        assert r["semester"] % 2 == r["term"] % 2
    assert max(used.values()) <= 8


def test_planner_on_a_table(spark):
    from quarry.workload.audit import _pending

    pending, needs = _pending(spark, SMALL), tables.prerequisites(spark, SMALL)
    rows = audit.plan_semesters(pending, needs, 20).collect()
    wanted = {(r["student"], r["course"]) for r in pending.collect()}
    pairs = [(r["src"], r["dst"]) for r in needs.collect()]
    when = {(r["student"], r["course"]): r["semester"] for r in rows}
    assert set(when) <= wanted
    for (student, course), semester in when.items():
        assert all(when.get((student, a), 99) < semester for a, b in pairs if b == course and (student, a) in wanted)


def test_split_text(spark):
    body = ("A sentence of words. " * 30 + "\n\n") * 6
    docs = spark.createDataFrame([(1, body), (2, "short"), (3, "x" * 4000), (4, None)], "doc_id long, text string")
    rows = retrieval.split_text(docs).orderBy("doc_id", "chunk").collect()
    for d, whole in ((1, body), (3, "x" * 4000)):
        parts = [r["text"] for r in rows if r["doc_id"] == d]
        assert all(len(p) <= 1500 for p in parts)
        at = 0
        for p in parts:
            found = whole.find(p, max(0, at - 150))
            assert found <= at
            at = found + len(p)
        assert at == len(whole)
    assert [r["text"] for r in rows if r["doc_id"] in (2, 4)] == ["short", ""]


def test_sync_is_a_full_rebuild(spark):
    old = spark.createDataFrame([(1, "a" * 2000), (2, "b"), (3, "c")], "doc_id long, text string")
    new = spark.createDataFrame([(1, "a" * 2000), (2, "b" * 1700), (4, "d")], "doc_id long, text string")
    got = sync.sync(old, new, retrieval.chunks(old))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, retrieval.chunks(new).collect()))


def test_answer_and_embedding_slots(spark):
    docs = spark.createDataFrame([(1, "the red fox"), (2, "a blue whale"), (3, "what red whales eat")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "what is red?")], "query long, text string")
    got = sync.answer(asked, docs, [("definition", ("what",))]).orderBy("rank").collect()
    assert got[0]["doc"] == 3 and got[0]["intent"] == "definition"
    sizes = sync.batch_embed(docs, lambda texts: [[float(len(t))] for t in texts], batch=2).collect()
    assert [r["embedding"] for r in sizes] == [[11.0], [12.0], [19.0]]
    assert sum(docs.select(sync.vectors_by_hash("text", 8).alias("v")).first()["v"]) == 3


def test_text_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first()["v"]
    assert value(text.slug(F.lit("Transferência interna e externa"))) == "transferencia-interna-e-externa"
    assert value(text.graph_key(F.lit("  Cálculo de Várias Variáveis, e mais "))) == "calculo varias variaveis mais"
    assert value(text.truncate_words(F.lit("one two three"), 9)) == "one two…"
    assert value(text.html_to_text(F.lit("<p>a&nbsp;&amp; b</p><script>x</script> c"))) == "a & b c"
    assert value(text.canonical_url(F.lit("https://A.org/x/y/?q=1#z"))) == "https://a.org/x/y"
    assert value(text.singular(F.lit("cursos"))) == "curso" and value(text.singular(F.lit("gas"))) == "gas"
    assert value(text.json_object(F.lit('so: {"a": {"b": 1}} end'))) == '{"a": {"b": 1}}'
    assert value(text.phrase(F.lit("A Plan, please"), "plan")) is True and value(text.phrase(F.lit("planet"), "plan")) is False
    assert value(routing.activities(F.lit("course of music 30 h, fair 12,5h; nothing"))) == [("course of music", 30.0), ("fair", 12.5)]
    assert value(validation.judge_score(F.lit("score: 9"))) == 5 and value(validation.judge_score(F.lit("none"))) == 0


def test_relations_are_not_repeated(spark):
    nodes = spark.createDataFrame([("A:1", "a", "1")], "node_id string, kind string, name string")
    edges = spark.createDataFrame([("A:1", "A:1", "R", 1.0)], "src string, dst string, relation string, conf double")
    found = spark.createDataFrame([("A:1", "A:1", "R", 0.5), ("A:1", "B:2", "R", 0.5), ("A:1", "B:2", "R", 0.7)], "src string, dst string, relation string, conf double")
    n, e = graph.add_relations(nodes, edges, found)
    assert sorted(r["node_id"] for r in n.collect()) == ["A:1", "B:2"]
    assert sorted(map(tuple, e.collect())) == [("A:1", "A:1", "R", 1.0), ("A:1", "B:2", "R", 0.7)]
