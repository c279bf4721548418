"""Every query of the library against its SQL, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from quarry import catalog

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS FROM '{SMALL}/{f}'")
    return con


def plain(value):
    return float(f"{value:.9g}") if isinstance(value, float) and math.isfinite(value) else value


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, con, name):
    got = catalog.queries()[name](spark, SMALL)
    expected = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted((tuple(map(plain, r)) for r in got.select(*columns).collect()), key=repr)
    assert rows == sorted((tuple(map(plain, r)) for r in expected.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
