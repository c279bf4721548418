"""Spans that don't nest, words of one holder only, and the cascade of grounding, on golden cases and against brute force."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import grounding


def test_nested_and_overlapping_names(spark):
    names = ["Cálculo", "Cálculo em Várias Variáveis", "Várias Variáveis", "Variáveis Aleatórias", "Banco de Dados", "Dados"]
    said = [(1, "Quero Cálculo em Várias Variáveis, depois Cálculo e Dados."), (2, "várias variáveis aleatórias"), (3, "Banco Dados! dados?"), (4, None), (5, "")]
    found = grounding.outermost(grounding.spans(spark.createDataFrame(said, "id long, text string"), spark.createDataFrame([(n, n) for n in names], "name string, target string")))
    assert sorted((r.id, r.target) for r in found.collect()) == [
        (1, "Cálculo"), (1, "Cálculo em Várias Variáveis"), (1, "Dados"), (2, "Variáveis Aleatórias"), (2, "Várias Variáveis"), (3, "Banco de Dados"), (3, "Dados"),
    ]


def test_sweep_by_brute_force(spark):
    draw = random.Random(3)
    spans = [(draw.randrange(20), a := draw.randrange(30), a + draw.randrange(6), str(k)) for k in range(300)]
    want = [s for s in spans if not any(o[0] == s[0] and o[1] <= s[1] and o[2] >= s[2] and o[2] - o[1] > s[2] - s[1] for o in spans)]
    got = grounding.outermost(spark.createDataFrame(spans, "id int, first int, last int, target string")).select("id", "first", "last", "target")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_words_of_one_holder(spark):
    people = spark.createDataFrame([("Lilian Berton", "d1"), ("Ana Silva", "d2"), ("Eduardo Silva", "d3"), ("Zé Ana", "d4")], "name string, target string")
    assert sorted(map(tuple, grounding.own_words(people).collect())) == [("berton", "d1"), ("eduardo", "d3"), ("lilian", "d1")]


def test_cascade(spark):
    nodes = spark.createDataFrame([("A", "Compiladores", "LFA"), ("B", "Teoria da Computação", "TC"), ("C", "Computação Gráfica", "CG"), ("D", "Lilian Berton", None)], "node_id string, name string, code string")
    asked = [
        (1, "o que é compiladores?", "compiladores"), (2, "e tc?", "TC"), (3, "sobre gráfica", "grafica"), (4, "quero fazer feito teoria da computacao já", "feito disciplinas total"),
        (5, "o que a lilian dá?", "o q"), (6, "nada aqui", "xyz"), (7, "computação gráfica ou compiladores", None), (8, "com lilian ou berton", ""),
    ]
    keys = {"name": text.graph_key("name"), "code": F.lower("code")}
    people = spark.createDataFrame([("Lilian Berton", "D"), ("Ana Berto", "E")], "name string, target string")
    out = grounding.ground(spark.createDataFrame(asked, "id long, text string, term string"), nodes, keys, aliases=grounding.own_words(people), share_word=True)
    assert {r.id: (r.node_id, r.how) for r in out.collect()} == {
        1: ("A", "key"), 2: ("B", "key"), 3: ("C", "part"), 4: ("B", "mention"), 5: ("D", "alias"), 6: (None, "none"), 7: ("C", "mention"), 8: ("D", "alias"),
    }
    loose = grounding.ground(spark.createDataFrame([(1, "", "omputa")], "id long, text string, term string"), nodes, keys)
    assert [tuple(r) for r in loose.collect()] == [(1, "omputa", "B", "part")]
    strict = grounding.ground(spark.createDataFrame([(1, "", "omputa")], "id long, text string, term string"), nodes, keys, share_word=True)
    assert [tuple(r) for r in strict.collect()] == [(1, "omputa", None, "none")]


def test_names_of_many_nodes(spark):
    """Thousands of nodes of one name meet a question once, by the least of them; an alias of several targets agrees on none."""
    nodes = spark.range(30_000).selectExpr("cast(id AS string) AS node_id", "if(id % 2 = 0, 'small green box', 'tall lamp') AS name")
    asked = spark.range(20_000).selectExpr("id", "CASE id % 4 WHEN 0 THEN 'of small green box say' WHEN 1 THEN 'one tall lamp' WHEN 2 THEN 'by ann' ELSE 'by bob' END AS text", "if(id % 8 = 0, 'green', '?') AS term")
    aliases = spark.createDataFrame([("ann", "A"), ("bob", "B"), ("bob", "C")], "name string, target string")
    out = grounding.ground(asked, nodes, {"name": text.graph_key("name")}, aliases=aliases)
    assert {(r.node_id, r.how): r["count"] for r in out.groupBy("node_id", "how").count().collect()} == {("0", "part"): 2500, ("0", "mention"): 2500, ("1", "mention"): 5000, ("A", "alias"): 5000, (None, "none"): 5000}
    # spans that a term's stages look at: one for each question and name
    left = asked.where("id % 4 < 2").select("id", "text")
    assert grounding._standing(left, grounding._bounds(nodes.selectExpr("name", "node_id AS target"))).count() == 10_000
