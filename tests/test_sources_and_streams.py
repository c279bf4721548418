"""Readers of files and pages, writers, and streams against their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import conversation
from quarry.sources import markdown, sinks, web
from quarry.streaming import events
from quarry.tables import table

SMALL = "/root/testdata/sf0.001"

COURSE = """# Banco de Dados
**Código:** 1234
**Sigla:** BD
**Termo:** 5 (noturno)
**Curso(s):** BCC, BCT
## Docentes
- Ana Souza
- Rui Lima
## Pré-requisitos
- Estruturas de Dados (Código: 99)
## Ementa
Modelos de dados.
"""
CURRICULUM = """# Matriz Curricular - Computação (BCC)
### Termo 1
| Disciplina | Créditos |
|---|---|
| Lógica | 4 |
| Cálculo | 6 |
### Eletivas
| Jogos | 2 |
"""
RULES = """# Regimento
### Das bolsas
**Art. 1.** A bolsa segue o art. 2.
linha dois
### Dos prazos
**Art. 2.** Prazo fixo.
**Pergunta:** Quando?
**Resposta:** Sempre.
**Pergunta:** Onde?
**Resposta:** Aqui.
"""
TEACHERS = """# Docentes
### Prof. Dr. Ana Souza
**Áreas:** Bancos, Grafos
**Email:** ana@x.org
### Profa. Dra. Bia Reis
**Áreas:** n/a
**Sala:** 12
"""
TRANSCRIPT = """NOME X
2023/1
101 - ALGORITMOS
  Docente: A   4  8,0 APR
102 - CALCULO
  Docente: B   6  - CURSANDO
2023/2
103 - FISICA
  4  4.8 REP
"""


def files(spark, *contents):
    return spark.createDataFrame([(f"f{i}.md", c) for i, c in enumerate(contents)], "path string, content string")


def test_whole_files(spark, tmp_path):
    (tmp_path / "a.md").write_text(COURSE)
    (tmp_path / "b.md").write_text(RULES)
    got = markdown.files(spark, f"{tmp_path}/*.md")
    kinds = {r["path"].rsplit("/", 1)[1]: r["k"] for r in got.select("path", markdown.kind("content", "path").alias("k")).collect()}
    assert kinds == {"a.md": "course", "b.md": "regulation"}


def test_course_files(spark):
    f = files(spark, COURSE)
    c = markdown.courses(f).first()
    assert (c["name"], c["code"], c["acronym"], c["term"]) == ("Banco de Dados", "1234", "BD", 5)
    assert c["programmes"] == ["BCC", "BCT"] and c["teachers"] == ["Ana Souza", "Rui Lima"] and c["syllabus"] == "Modelos de dados."
    assert [tuple(r) for r in markdown.course_prerequisites(f).collect()] == [("Banco de Dados", "Estruturas de Dados", "99")]


def test_curricula_teachers_and_rules(spark):
    rows = markdown.curricula(files(spark, CURRICULUM)).collect()
    assert [(r["acronym"], r["term"], r["course"], r["credits"]) for r in rows] == [("BCC", 1, "Lógica", 4), ("BCC", 1, "Cálculo", 6), ("BCC", None, "Jogos", 2)]
    got = markdown.teachers(files(spark, TEACHERS)).collect()
    assert [(r["name"], r["email"], r["room"], r["area"]) for r in got] == [("Ana Souza", "ana@x.org", None, "Bancos"), ("Ana Souza", "ana@x.org", None, "Grafos"), ("Bia Reis", None, "12", None)]
    arts = markdown.articles(files(spark, RULES)).orderBy("number").collect()
    assert [(r["number"], r["heading"], r["refers_to"]) for r in arts] == [(1, "Das bolsas", [2]), (2, "Dos prazos", [])]
    assert arts[0]["body"].endswith("linha dois")
    assert [(r["question"], r["answer"]) for r in markdown.questions(files(spark, RULES)).collect()] == [("Quando?", "Sempre."), ("Onde?", "Aqui.")]
    long = "# t\n## Resumo é\n" + "x" * 90 + "\n## Curto\nnada\n"
    assert [(r["heading"], len(r["text"])) for r in markdown.section_chunks(files(spark, long)).collect()] == [("resumo e", 90)]


def test_transcripts(spark):
    rows = markdown.transcripts(files(spark, TRANSCRIPT)).collect()
    assert [(r["year"], r["half"], r["code"], r["course"], r["credits"], r["grade"], r["status"]) for r in rows] == [
        (2023, 1, "101", "ALGORITMOS", 4, 8.0, "APR"), (2023, 1, "102", "CALCULO", 6, None, "CURSANDO"), (2023, 2, "103", "FISICA", 4, 4.8, "REP"),
    ]


def test_pages(spark):
    html = "<h1>T</h1><h2>One</h2><p>" + "a " * 5000 + "</p><h3>Two</h3>" + "b " * 5000
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    rows = web.sections(pages).orderBy("section", "part").collect()
    assert len(rows) == 4 and all(len(r["body"]) <= 6000 for r in rows) and [r["title"] for r in rows] == ["One", "One", "Two", "Two"]
    table_ = spark.createDataFrame([(1, "<table><tr><th>a</th><td>b <b>c</b></td></tr></table>")], "page_id long, html string")
    assert web.table_rows(table_).first()["markdown"] == "| a | b c |"


def test_crawl_and_feeds(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("a", "c")], "src string, dst string")
    got = {r["url"]: r["depth"] for r in web.crawl_order(links, spark.createDataFrame([("a",)], "url string"), 2).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2}
    xml = "<rss><item><title>Old</title><link>u1</link><pubDate>Mon, 01 Jan 2024 10:00:00 +0000</pubDate></item><item><title><![CDATA[New & hot]]></title><link>u2</link><pubDate>Tue, 2 Jan 2024 10:00:00 +0000</pubDate></item></rss>"
    rows = web.feed_items(spark.createDataFrame([("f", xml)], "feed string, xml string")).collect()
    assert [r["title"] for r in rows] == ["New & hot", "Old"]
    seeds = spark.createDataFrame([({"k": [" a", ""], "l": ["b"]},)], "entries map<string, array<string>>")
    assert sorted(map(tuple, web.seed_map(seeds, "concept", "course").collect())) == [("k", "a"), ("l", "b")]
    scope = spark.createDataFrame([("https://x.org/a",), ("https://x.org/a.pdf",), ("https://y.org/",)], "url string")
    assert [r[0] for r in scope.select(web.in_scope("url", ("x.org",))).collect()] == [True, False, False]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "source long, text string")
    rows.write.parquet(f"{tmp_path}/one")
    sinks.upsert(spark, f"{tmp_path}/one", spark.createDataFrame([(2, "c"), (2, "d")], "source long, text string"), "source", f"{tmp_path}/two")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/two").collect())) == [(1, "a"), (2, "c"), (2, "d")]
    for ts in ("2024-01-01", "2024-01-03", "2024-01-02"):
        sinks.append_log(spark.createDataFrame([(ts, "q")], "ts string, q string"), f"{tmp_path}/log")
    assert [r["ts"] for r in sinks.read_log(spark, f"{tmp_path}/log", "ts string, q string", 2).collect()] == ["2024-01-03", "2024-01-02"]
    assert sinks.manifest(rows, "source", "text").count() == 2


def finish(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_streamed_counts_and_duplicates(spark, tmp_path):
    source = tmp_path / "in"
    batch = table(spark, SMALL, "events")
    batch.repartition(3).write.parquet(str(source))
    stream = events.read(spark, str(source), events.EVENTS)
    query = events.counts(stream).writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    finish(query)
    expected = batch.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, expected.collect()))
    finish(events.run(events.distinct_events(events.read(spark, str(source), events.EVENTS), "3650 days"), str(tmp_path / "out"), str(tmp_path / "c2")))
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.select("event_id").distinct().count()


def test_streamed_entities_equal_batch(spark, tmp_path):
    source = tmp_path / "turns"
    turns = table(spark, SMALL, "conversations")
    turns.coalesce(1).write.parquet(str(source))
    stream = events.read(spark, str(source), events.TURNS)
    finish(events.run(events.carried(stream), str(tmp_path / "out"), str(tmp_path / "c")))
    got = spark.read.parquet(str(tmp_path / "out"))
    own = F.nullif(F.regexp_extract(F.lower("text"), "([a-z]{9,})", 1), F.lit(""))
    expected = conversation.carried(turns, own).select("conv_id", "turn", "entity")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
