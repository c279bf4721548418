"""A curriculum of very many lines: the file's own title is read once, not for each line."""

from __future__ import annotations

import time

from quarry.sources import markdown


def test_long_curriculum(spark):
    rows = spark.range(60_000).selectExpr("concat('| Course ', id, ' | ', 2 + id % 5, ' |') AS line")
    body = "concat('# Matriz Curricular - Long (LG)\\n\\n### Termo 3\\n\\n| Disciplina | Créditos |\\n|---|---|\\n', array_join(collect_list(line), '\\n'), '\\n')"
    files = rows.selectExpr("'a' AS path", f"{body} AS content").cache()
    files.count()
    began = time.time()
    found = markdown.curricula(files).groupBy("programme", "acronym", "term").count().collect()
    assert [tuple(r) for r in found] == [("Long", "LG", 3, 60_000)]
    assert time.time() - began < 15
