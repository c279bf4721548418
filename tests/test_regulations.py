"""Additive weights of typed documents, the union with a semantic list, equal openings, and the scorer."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import regulations


def test_weights(spark):
    docs = spark.createDataFrame([
        (1, "Regimento do curso", "article", None, None), (2, "PERGUNTA: onde ficam as bibliotecas novas?", "question", None, None), (3, "Termo 2 da computação", "term", "BCC", 2),
        (4, "Eletivas do grupo 1", "electives", "BCC", None), (5, "Objetivo", "objective", None, None), (6, "nada", "article", None, None), (7, None, "summary", None, None),
    ], "doc long, text string, kind string, acronym string, number int")
    queries = spark.createDataFrame([(1, "Regimento do curso"), (2, "onde ficam bibliotecas?"), (3, "segundo termo do BCC"), (4, "eletivas de que grupo?"), (5, None)], "query long, text string")
    got = {}
    for r in regulations.by_weight(docs, queries).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append((r.doc, r.score))
    always = {2: 10.0, 7: 5.0, 5: 3.0}
    assert dict(got[1]) == always | {1: 4 + 3} and dict(got[5]) == always
    assert dict(got[2]) == always | {2: 10 + 3 * 5 + 3}  # onde, ficam, bibliotecas as long words; biblioteca as a word
    # both of 'segundo' and 'segundo termo' name the term; the word 'termo' counts too, and the acronym
    assert dict(got[3]) == always | {3: 2 * 20 + 4 + 15, 4: 15}
    # eletiva, eletivas and grupo; both electives and groups
    assert dict(got[4]) == always | {4: 8 + 8 + 6 + 12}
    assert [d for d, _ in got[3]] == [3, 4, 2, 7, 5]


def test_united(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a" * 130, "a" * 120 + "b", "c", "d", None, ""])], "doc long, text string")
    weighted = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "query long, rank int, doc long")
    semantic = spark.createDataFrame([(1, 1, 0), (1, 2, 2), (1, 3, 3), (1, 4, 4), (1, 5, 5), (1, 9, 3), (2, 1, 3)], "query long, rank int, doc long")
    rows = lambda **options: sorted(map(tuple, regulations.united(weighted, semantic, docs, **options).collect()))
    assert rows() == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, 4), (2, 1, 3)]
    assert rows(scorer=-F.col("doc"), most=2) == [(1, 1, 1), (1, 2, 2), (2, 1, 3)]
    assert rows(scorer=F.col("doc"), most=2) == [(1, 1, 4), (1, 2, 3), (2, 1, 3)]
