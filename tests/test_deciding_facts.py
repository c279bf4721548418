"""Which facts decide a claim."""

from __future__ import annotations

from quarry.operators import validation


def test_claims_are_decided_by_few_facts(spark):
    names = spark.createDataFrame([("Steel Nail", 1), ("steel", 2), ("brass", 3), ("", 4)], "value string, item long")
    claimed = spark.createDataFrame([(1, "steel nail"), (2, "STEEL"), (3, "tin"), (4, ""), (5, None)], "course long, value string")
    got = sorted(map(tuple, validation.deciding(claimed, names).collect()), key=str)
    assert got == sorted([(1, 1), (1, 2), (2, 1), (2, 2), (3, None), (4, None), (5, None)], key=str)
