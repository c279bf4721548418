"""Bases of a concept that very many courses require and cover: against brute force, and without pairing all of them."""

from __future__ import annotations

import random
import time

from quarry.operators import similarity


def test_against_brute_force(spark):
    draw = random.Random(5)
    requires = sorted({(draw.randrange(60), draw.choice("abc"), draw.randrange(1, 9) / 8) for _ in range(90)})
    covers = sorted({(draw.randrange(60), draw.choice("abc"), draw.randrange(1, 9) / 8) for _ in range(90)})
    ties = {(draw.randrange(60), draw.randrange(60)) for _ in range(1500)}
    best = {}
    for c, k in {(c, k) for c, k, _ in requires}:
        some = [(-min(n, g), b) for c2, k2, n in requires if (c2, k2) == (c, k) for b, k3, g in covers if k3 == k and b != c and (c, b) not in ties and (b, c) not in ties]
        if some:
            s, b = min(some)
            best[c, b] = max(best.get((c, b), 0), -s)
    want = {(c, b, s) for (c, b), s in best.items()}
    made = lambda rows, names: spark.createDataFrame(rows, names)
    got = similarity.concept_base(made(requires, "course long, concept string, conf double"), made(covers, "course long, concept string, conf double"), made(sorted(ties), "node long, ancestor long"))
    assert {(r.course, r.base, r.confidence) for r in got.collect()} == want


def test_common_concept(spark):
    """40,000 courses that require what 40,000 others cover are 1.6 thousand million pairs."""
    requires = spark.range(40_000).selectExpr("id AS course", "'x' AS concept", "0.5D AS conf")
    covers = spark.range(40_000).selectExpr("id + 50000 AS course", "'x' AS concept", "0.9D AS conf")
    ties = spark.range(40_000).selectExpr("id AS node", "50000L AS ancestor")
    began = time.time()
    assert {(r.base, r.rank) for r in similarity.concept_base(requires, covers, ties).select("base", "rank").distinct().collect()} == {(50_001, 1)}
    assert time.time() - began < 60
