"""Transcripts of several lines a course: a golden one, a broken one, and the check of the mean."""

from __future__ import annotations

from quarry.sources import records

GOLDEN = """
Nome: Fulana   Curso: Ciência da Computação
Ano de ingresso: 2021
ANO/SEM | 2021/1 Coeficiente de Rendimento (CR): 7,5
4754 - LÓGICA DE PROGRAMAÇÃO
Docente: Ana B. 121 DF 72 0 4 90 8,0 APROVADO
5845 - ATIVIDADE
 um comentário
Docente: Bia C. 102 E 36 10,5 2 100 6.5 APROVADO SEM EXAME
ANO/SEM | 2021/2 Coeficiente de Rendimento (CR): 5
111 - ESTÁGIO
Docente: 182 AE 100 0 - NÃO  CUMPRIDO
222 - OUTRO CURSO
33 - NO CODE
333 - ÁLGEBRA
Docente: C 121 DF 72 4 75 3,9 REPROVADO
Docente: D 121 DF 72 4 75 9,9 APROVADO
4444 - TCC
Docente: E 121 O 36 2 EM CURSO
FIXAS 900
ELETIVAS 120
ATIVIDADES COMPLEMENTARES 30
Total de horas cumpridas pelo estudante: 1050
Carga horária extensionista: 12 horas
Coeficiente de Rendimento (CR) Geral: 6,06
"""


def rows(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "path string, content string")


def test_golden(spark):
    files = rows(spark, a=GOLDEN.replace("\n", "\r\n"))
    found = [tuple(r)[2:] for r in records.courses(files).orderBy("at").collect()]
    assert found == [
        ("2021/1", "4754", "Lógica De Programação", "121", "DF", 72, 0.0, 4, 90, 8.0, "APROVADO"),
        ("2021/1", "5845", "Atividade", "102", "E", 36, 10.5, 2, 100, 6.5, "APROVADO SEM EXAME"),
        ("2021/2", "111", "Estágio", "182", "AE", 100, 0.0, 0, None, None, "NÃO CUMPRIDO"),
        ("2021/2", "333", "Álgebra", "121", "DF", 72, 0.0, 4, 75, 3.9, "REPROVADO"),
        ("2021/2", "4444", "Tcc", "121", "O", 36, 0.0, 2, None, None, "EM CURSO"),
    ]
    assert [(r.term, r.mean) for r in records.semesters(files).orderBy("at").collect()] == [("2021/1", 7.5), ("2021/2", 5.0)]
    (one,) = records.summary(files).collect()
    assert one.asDict() == {
        "path": "a", "programme": "Ciência da Computação", "courses": 5, "credits": 12, "running": 1, "mean": 6.06, "stated": 6.06, "agrees": True,
        "fixed_hours": 900, "elective_hours": 120, "hours": 1050, "extension_hours": 12, "activity_hours": 30, "entry_year": 2021,
    }


def test_broken(spark):
    off = GOLDEN.replace("Geral: 6,06", "Geral: 6,2")
    files = rows(spark, off=off, none=None, empty="", loose="Docente: X 121 DF 72 4 75 9,9 APROVADO\n777 - A\nDocente: without figures\nDocente: X 121 DF 72 4 75 9,9 APROVADO", no_mean=GOLDEN.split("Coeficiente de Rendimento (CR) Geral")[0])
    got = {r.path: (r.courses, r.mean, r.stated, r.agrees) for r in records.summary(files).collect()}
    assert got == {"off": (5, 6.06, 6.2, False), "none": (0, None, None, False), "empty": (0, None, None, False), "loose": (0, None, None, False), "no_mean": (5, 6.06, None, False)}
