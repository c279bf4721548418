"""Signs of symbolic answers, kind by kind."""

from __future__ import annotations

from quarry.operators import validation


def test_signs(spark):
    cases = [
        ("  ", "x", False, "empty_response"), (None, "listar", False, "empty_response"), ("Sequência: A → B", "trajectory_planning", True, "trajectory_keywords_found"), ("1. Cálculo; 2. Física", "trajectory_planning", True, "ordered_list_found"),
        ("nada disso aqui", "trajectory_planning", False, "no_trajectory_indicators"), ("| a | b |\n|---|---|", "critical_disciplines", True, "markdown_table_found"), ("As mais Críticas:\n• Cálculo", "critical_disciplines", True, "critical_list_found"),
        ("As mais críticas são", "critical_disciplines", False, "no_critical_table_or_list"), ("Não há nenhuma aqui", "co_prerequisite", True, "explicit_empty_result"), ("* Álgebra linear", "co_prerequisite", True, "list_found"),
        ("É necessário cursar X", "dependentes", True, "prereq_keywords_found"), ("resposta vazia", "prereq", False, "no_prereq_indicators"), ("Quem ministra é Ana", "discipline_docentes", True, "docente_keywords_found"),
        ("ninguém sabe disso", "discipline_docentes", False, "no_docente_keywords"), ("só | tabela aqui", "termo", True, "table_found"), ("texto corrido só", "listar", False, "no_list_or_table"),
        ("Não encontrei isso", "faqs", False, "error_in_response"), ("uma resposta boa", None, True, "non_empty_response"),
    ]
    rows = spark.createDataFrame([(i, a, k) for i, (a, k, _, _) in enumerate(cases)], "i int, a string, k string")
    got = [(r.v.ok, r.v.why) for r in rows.select("i", validation.verified("a", "k").alias("v")).orderBy("i").collect()]
    assert got == [c[2:] for c in cases]
