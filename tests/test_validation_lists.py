"""Items of long lists: every distinct word is looked for once, and words within longer runs of letters count."""

from __future__ import annotations

import time

from quarry.operators import validation


def test_words_within_runs(spark):
    rows = [
        (1, "- alpha beta1\n- Árvore\n- x y", "ALPHABET árvores"), (2, "- alpha\n- beta\n- quatro5cinco", "alpha quatro"), (3, "- alpha\n- beta", ""), (4, "- a b\n- c\n- d", None), (5, "- alpha\n- b\n- c", None), (6, None, "alpha"),
    ]
    df = spark.createDataFrame(rows, "id int, b string, a string")
    assert {r.id: r.kept for r in df.select("id", validation.list_items_kept("b", "a").alias("kept")).collect()} == {1: False, 2: False, 3: True, 4: True, 5: False, 6: None}


def test_long_lists(spark):
    """A list of 40,000 different words against a text of as many: the work is not that of all words times the text."""
    word = "translate(lpad(string(id), 6, '0'), '0123456789', 'abcdefghij')"
    lines = spark.range(40_000).selectExpr(f"concat('- ', {word}) AS line", f"if(id % 20 = 0, '', concat('_', {word})) AS other")
    text = lines.selectExpr("array_join(collect_list(line), '\\n') AS b", "array_join(collect_list(other), '\\n') AS a").cache()
    text.count()
    began = time.time()
    assert text.select(validation.list_items_kept("b", "a").alias("kept")).collect()[0].kept is True
    assert time.time() - began < 20
