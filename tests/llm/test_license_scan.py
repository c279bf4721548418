from __future__ import annotations

import re
from itertools import combinations

from quarry.llm import queries
from quarry.llm.common import table
from quarry.llm.license_scan import FULL_TEXTS, TEMPLATES, Template, align, increasing, scan, scan_text


def test_longest_increasing_subsequence():
    for values in ([3, 1, 2, 5, 4], [5, 4, 3], [1, 2, 3], [2, 9, 3, 8, 4, 7, 1], []):
        got = [j for _, j in increasing(list(enumerate(values)))]
        longest = max((n for n in range(len(values) + 1) if any(list(c) == sorted(c) for c in combinations(values, n))), default=0)
        assert got == sorted(got) and len(got) == longest


def test_alignment_recurses_into_gaps():
    a = "the license of the work is the license here under the terms".split()
    b = "the work is here under terms".split()
    pairs = align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
    assert [b[j] for _, j in pairs] == b


def test_templates_cover_themselves():
    made = [Template(k, v, 0.8) for k, v in TEMPLATES.items()]
    for name, text in TEMPLATES.items():
        found = {r[0]: r for r in scan_text(f"Some text.\n{text}\nmore text, {text.upper()} end".encode(), made)}
        assert found[name][1] == found[name][2] and found[name][5] == 2


def test_edits_are_tolerated_and_other_texts_are_not():
    made = [Template(k, v, 0.8) for k, v in TEMPLATES.items()]
    near = "This (great) work is licensed under the well-known GNU General Public License version 3!"
    assert [r[0] for r in scan_text(near.encode(), made)] == ["gpl-3.0"]
    assert scan_text(b"A license to drive was released by the general public under the work.", made) == []
    assert scan_text(b"", made) == []


def test_adjacent_notices_are_found_one_by_one():
    for name, text in TEMPLATES.items():
        made = [Template(name, text, 0.8)]
        n, middle = len(made[0].words), len(text.split()) // 2
        put_in = " ".join([*text.split()[:middle], "foo", "bar", *text.split()[middle:]])
        cut = text.split(maxsplit=1)[1]
        for notice, matched in ((text, n), (put_in, n), (cut, n - 1)):
            for times in (2, 3, 7, 300):
                [got] = scan_text(f"{notice}\n".encode() * times, made)
                assert (got[2], got[5]) == (matched, times), (name, notice[:40], times, got)


def test_rows(spark):
    mit = "Released under the MIT License."
    rows = [(1, None, "x"), (2, "", "x"), (3, mit, "x"), (3, mit, "x"), (None, mit, "x"), (4, "word " * 50_000 + mit, "x"), (5, (mit + "\n") * 300, "x")]
    got = scan(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()
    assert sorted((r["doc_id"] or 0, r["license"], r["occurrences"]) for r in got) == [(0, "mit", 1), (3, "mit", 1), (3, "mit", 1), (4, "mit", 1), (5, "mit", 300)]
    assert {r["first_word"] for r in got if r["doc_id"] == 4} == {50_000}
    assert scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_whole_table_against_plain_search(spark):
    """The notices of the table stand there unchanged, so a search for their words one after another finds the same documents."""
    small = "/root/testdata/sf0.01"
    expected = set()
    for r in table(spark, small, "documents").collect():
        words = " " + " ".join(re.findall("[a-z0-9]+", r["text"].lower())) + " "
        expected |= {(r["doc_id"], name) for name, t in TEMPLATES.items() if " " + " ".join(re.findall("[a-z0-9]+", t.lower())) + " " in words}
    got = {(r["doc_id"], r["license"]) for r in queries.op6_license_scan(spark, small).collect()}
    assert got == expected and got


def test_edited_full_texts_are_found(spark):
    """Full texts with a twelfth of their words changed, dropped or doubled, in the midst of others, are all found; broken by a short insertion too."""
    import random

    draw = random.Random(11)
    rows = []
    full = list(FULL_TEXTS)
    for n in range(60):
        words = FULL_TEXTS[full[n % len(full)]].split()
        for _ in range(len(words) // 12):
            at = draw.randrange(len(words))
            words[at : at + 1] = draw.choice(([], ["changed"], [words[at]] * 2))
        if n % 2:
            at = draw.randrange(len(words))
            words[at:at] = [f"inserted{k}" for k in range(20)]
        around = [f"word{draw.randint(0, 99)}" for _ in range(60)]
        rows.append((n, " ".join(around[:30] + words + around[30:])))
    got = {(r["doc_id"], r["license"]) for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all((n, full[n % len(full)]) in got for n in range(60))
    for name, text in FULL_TEXTS.items():
        assert [r[5] for r in scan_text(f"{text}\n".encode() * 3, [Template(name, text, 0.8)])] == [3]
    plain = spark.createDataFrame([(1, " ".join(f"word{k}" for k in range(500)))], "doc_id long, text string")
    assert scan(plain).collect() == [] and scan(plain.limit(0)).collect() == []
