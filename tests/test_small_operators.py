"""Preferences of requirement seeds, plan events, overviews, expanded questions, titles, crawls and results as files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import audit, curriculum, repair, retrieval
from quarry.sources import markdown, sinks


def test_requirement_seed(spark):
    seeds = spark.createDataFrame([("BCC", "integral", 0, "a"), ("BCC", "noturno", 1, "b"), ("BCT", "noturno", 2, "c"), ("BCT", "vespertino", 3, "d")], "acronym string, shift string, at int, seed string")
    students = spark.createDataFrame([(1, "bcc", "Computação - Noturno"), (2, "BCC", None), (3, "BCT", "integral"), (4, "XX", ""), (5, None, None)], "student int, acronym string, programme string")
    assert {r.student: r.seed for r in audit.requirement_seed(students, seeds).collect()} == {1: "b", 2: "a", 3: "c"}


def test_plan_events(spark):
    plan = spark.createDataFrame([(1, 2, 30, 4), (1, 1, 20, 4), (1, 1, 10, 6), (2, 5, 7, 2)], "student long, semester int, course long, credits int")
    rows = sorted((r.student, r.seq, r.event, json.loads(r.payload)) for r in audit.plan_events(plan).collect())
    assert [r[:3] for r in rows] == [(1, 0, "start"), (1, 1, "semester"), (1, 2, "semester"), (1, 3, "done"), (2, 0, "start"), (2, 1, "semester"), (2, 2, "done")]
    assert rows[0][3] == {"semesters": 2} and rows[1][3] == {"semester": 1, "courses": [10, 20], "credits": 10} and rows[3][3] == {"courses": 3, "credits": 14}


def test_overview(spark):
    courses = spark.createDataFrame([("P", 1, 1, "A", 4), ("P", 1, 2, "B", 2), ("P", None, 3, "E", 2)], "programme string, term int, course int, name string, credits int")
    electives = spark.createDataFrame([("P", "g1", 3, "E", 2)], "programme string, group string, course int, name string, credits int")
    led = spark.createDataFrame([("P", "Zoe"), ("P", "Ana")], "programme string, name string")
    assert sorted(map(tuple, curriculum.overview(courses, electives, led).collect())) == [("P", "electives", "g1", 1, 2, "E"), ("P", "term", "1", 2, 6, "A; B"), ("P", "total", "", 2, 6, "Ana; Zoe")]


def test_site_sections(spark):
    sections = spark.createDataFrame([(1, "https://x.org/a/bolsa-auxilio", "Apoio", "texto"), (2, "https://x.org/nae", "Núcleo de Apoio", None), (3, None, None, "bolsa " * 300)], "id int, url string, title string, text string")
    asked = spark.createDataFrame([(1, "Como pedir bolsa?"), (2, "onde fica o NAE"), (3, None)], "query int, text string")
    rows = retrieval.site_sections(sections, asked, {"nae": ["nucleo", "apoio"]}, ("como",)).collect()
    # bolsa counts 1.5 in a path and 1 in a text: both below 2; the acronym stands in a path, its words in titles
    assert sorted(map(tuple, rows)) == [(2, 1, 2, 1.5 + 2 * 2.0), (2, 2, 1, 2.0)]
    row = spark.createDataFrame([("<h1>Curso X - My Site, campus</h1>", "<title>Y | Other</title>")], "a string, b string").select(text.site_title("a", "my site").alias("a"), text.site_title("b", "my site").alias("b")).first()
    assert tuple(row) == ("Curso X", "Y | Other")


def test_crawls_and_results_as_files(spark, tmp_path):
    pages = spark.createDataFrame([("u1", "t"), ("u2", None)], "url string, text string")
    path, schema = str(tmp_path / "crawl"), "url string, text string"
    sinks.save_crawl(pages, path, "20240101T000000")
    sinks.save_crawl(pages.limit(1), path, "20240201T000000")
    assert [(r.url, r.at) for r in sinks.load_crawl(spark, path, schema).collect()] == [("u1", "20240201T000000")]
    assert sinks.load_crawl(spark, path, schema, "20240301T000000").collect() == []
    with pytest.raises(Exception, match="exist"):
        sinks.save_crawl(pages, path, "20240101T000000")
    one, two = (sinks.marker(p, "v1").first() for p in (pages, pages.orderBy(F.desc("url"))))
    assert one == two and one.pages == 2 and sinks.marker(pages.limit(1), "v1").first().digest != one.digest and sinks.marker(pages.limit(0), "v1").first().digest == "0"
    rows = spark.createDataFrame([(1, ["a", "b"], {"k": 0.5})], "id int, terms array<string>, scores map<string, double>")
    sinks.save_results(rows, str(tmp_path / "json"))
    sinks.save_results(rows, str(tmp_path / "csv"), "csv")
    assert spark.read.json(str(tmp_path / "json")).first().terms == ["a", "b"]
    back = spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "csv")).first()
    assert (back.id, json.loads(back.terms), json.loads(back.scores)) == ("1", ["a", "b"], {"k": 0.5})


def test_links_in_text(spark):
    context = "https://a.org/x/long-tail#one https://a.org/y/long-tail2 https://b.org/c#two https://d.org/c#two (https://e.org/same-tail) https://f.org/same-tail/"
    cases = [
        ("see http://bad/long-tail2.", "see https://a.org/y/long-tail2."), ("http://bad/q#one!", "https://a.org/x/long-tail#one!"), ("http://bad/c#two", "http://bad/c#two"), ("http://bad/same-tail", "http://bad/same-tail"),
        ("https://b.org/c#two, and http://bad/long-tail/", "https://b.org/c#two, and https://a.org/x/long-tail#one"), ("none", "none"), ("", ""), (None, None), ("http://bad/long-tail2http", "http://bad/long-tail2http"),
    ]
    rows = spark.createDataFrame([(i, a, context) for i, (a, _) in enumerate(cases)], "i int, a string, c string")
    assert [r.o for r in rows.select("i", repair.links_in_text("a", "c").alias("o")).orderBy("i").collect()] == [w for _, w in cases]
    assert rows.limit(1).select(repair.links_in_text("a", F.lit(None).cast("string")).alias("o")).first().o == "see http://bad/long-tail2."


def test_organ_mentions(spark):
    articles = spark.createDataFrame([("p", 1, "A Câmara de Graduação e o Conselho Universitário (CONSU)."), ("p", 2, "a câmara"), ("p", 3, None)], "path string, number int, body string")
    organs = spark.createDataFrame([("Câmara", "Câmara"), ("Câmara de Graduação", "Câmara de Graduação"), ("Conselho Universitário", "Conselho Universitário"), ("CONSU", "Conselho Universitário")], "name string, organ string")
    assert sorted(map(tuple, markdown.organ_mentions(articles, organs).collect())) == [("p", 1, "Conselho Universitário"), ("p", 1, "Câmara de Graduação"), ("p", 2, "Câmara")]
