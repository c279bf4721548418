"""The greedy plan against a plain one."""

from __future__ import annotations

import random

from quarry.operators import audit


def plain(courses, needs, cap, first=1, most=20):
    """(semester, course) of one student. courses: {course: (credits, term)}."""
    left, out, empty = dict(courses), [], 0
    for semester in range(first, first + most):
        used, now = 0, []
        for course in sorted(left, key=lambda c: (left[c][1], -left[c][0], c)):
            credits, term = left[course]
            ready = not any(b == course and a in left for a, b in needs)
            if term % 2 == semester % 2 and ready and (used + credits <= cap or not now):
                used, now = used + credits, [*now, course]
        for course in now:
            del left[course]
        out += [(semester, c) for c in now]
        empty = 0 if now else empty + 1
        if not left or empty == 3:
            break
    return out


def test_plans_by_brute_force(spark):
    draw = random.Random(14)
    needs = [(draw.randrange(30), draw.randrange(30)) for _ in range(45)]
    students = {s: {c: (draw.randint(1, 9), draw.randint(1, 10)) for c in draw.sample(range(30), draw.randint(1, 18))} for s in range(40)}
    pending = spark.createDataFrame([(s, c, *x) for s, own in students.items() for c, x in own.items()], "student long, course long, credits int, term int").repartition(5)
    for cap, first in ((12, 1), (5, 4)):
        got = audit.plan_semesters(pending, spark.createDataFrame(needs, "src long, dst long"), cap, first).collect()
        want = [(s, semester, c, *own[c]) for s, own in students.items() for semester, c in plain(own, needs, cap, first)]
        assert sorted(map(tuple, got)) == sorted(want)
