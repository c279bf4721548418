"""Each student's courses come from blocks of courses that meet blocks of students."""

from __future__ import annotations

import random
import re

from quarry.operators import audit


def test_rows_are_worked_out_once_a_programme(spark, monkeypatch):
    monkeypatch.setattr(audit, "COURSES", 3)
    monkeypatch.setattr(audit, "STUDENTS", 4)
    draw = random.Random(7)
    programme = {c: "ABC"[c % 3] for c in range(40)}
    pairs = {(a, b) for a, b in ((draw.randrange(40), draw.randrange(40)) for _ in range(90)) if a < b}
    own = {s: "ABD"[s % 3] for s in range(30)}
    had = {(draw.randrange(32), draw.randrange(45)) for _ in range(120)}
    want = {}
    for s, c in had:
        want[s, c] = ("done" if s in own and programme.get(c) == own[s] else "elective" if c in programme else "unknown", "")
    for s in own:
        for c in programme:
            if programme[c] == own[s] and (s, c) not in had:
                lack = sorted(a for a, b in pairs if b == c and programme[a] == own[s] and (s, a) not in had)
                want[s, c] = ("blocked", ",".join(map(str, lack))) if lack else ("available", "")
    frame = lambda rows, schema: spark.createDataFrame(sorted(rows), schema)
    out = audit.progress_detail(
        frame(had, "student long, course long"), frame(own.items(), "student long, programme string"), frame(programme.items(), "course long, programme string"), frame(pairs, "src long, dst long")
    )
    assert {(r.student, r.course): (r.status, r.missing) for r in out.collect()} == want and out.count() == len(want)
    # of untouched blocks nothing is worked out row by row
    lines = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    deep = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = [i for i, line in enumerate(lines) if "Generate " in line and "rows#" in line]
    above = [line for i in at for line in lines[:i] if deep(line) < deep(lines[i])]
    assert any(re.search(r"Generate inline\(rows#", lines[i]) for i in at) and not any("array_join" in line for line in above)
