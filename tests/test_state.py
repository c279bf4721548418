"""Keyed streaming state with timers against the batch operator: late, repeated, reordered and expired turns; the state shrinks."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarry.operators import conversation
from quarry.streaming import events, state

TURNS = "key long, at timestamp, number long, entity string, item string, reset boolean"
START = datetime(2024, 1, 1)


@pytest.fixture(params=["UTC", "America/Sao_Paulo"])
def store(spark, request):
    state.use_store(spark)
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield
    spark.conf.unset(state.STORE[0])
    spark.conf.set("spark.sql.session.timeZone", zone)


def plain(rows):
    return sorted((r.key, r.started, r.ended, r.turns, r.entity, tuple(r.items)) for r in rows)


def play(spark, tmp_path, batches, late="2 hours"):
    """One batch of the stream after another; what was written, and the number of turns in the state after each."""
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.createDataFrame([], TURNS).write.parquet(source)
    held = []
    for rows in batches:
        spark.createDataFrame(rows, TURNS).coalesce(1).write.mode("append").parquet(source)
        query = events.run(state.sessions(events.read(spark, source, TURNS), "24 hours", late), out, check)
        assert query.awaitTermination(120) and query.exception() is None
        held.append(state.open_turns(spark, check).count())
    return spark.read.schema(state.SESSIONS).parquet(out).collect(), held


def turn(key, hours, number, entity=None, item=None, reset=False):
    return key, START + timedelta(hours=hours), number, entity, item, reset


def test_planted_turns(spark, store, tmp_path):
    first = [turn(1, 0, 1, "ana", "x"), turn(1, 10, 2, None, "y"), turn(2, 0, 1, "bob", "z"), turn(1, 10, 2, None, "y")]
    second = [turn(1, 9, 3, None, "x"), turn(1, 34, 4, None, "w", True), turn(2, 34, 2, None, "q"), turn(1, 10, 2, "repeated", "y"), turn(3, 33, 1)]
    third = [turn(1, 20, 5, "late"), turn(9, 200, 1, "far", "f")]  # behind the watermark of 32 hours
    rows, held = play(spark, tmp_path, [first, second, third, [turn(9, 201, 2)]])
    hour = lambda h: START + timedelta(hours=h)
    assert plain(rows) == [
        ("1", hour(0), hour(34), 4, "ana", ("w",)), ("2", hour(0), hour(0), 1, "bob", ("z",)), ("2", hour(34), hour(34), 1, None, ("q",)), ("3", hour(33), hour(33), 1, None, ()),
    ]
    assert held == [3, 6, 1, 2]


def test_stream_equals_batch(spark, store, tmp_path):
    """Turns in a random order within the delay, some sent again; those of closed sessions come out as the batch operator has them."""
    draw = random.Random(3)
    turns = [turn(k, h + draw.random(), n, draw.choice([None, "e", "f"]), draw.choice([None, "p", "q", "r"]), draw.random() < 0.1) for k in range(12) for n, h in enumerate(sorted(draw.sample(range(600), 25)))]
    turns.sort(key=lambda t: t[1] + timedelta(hours=40 * draw.random()))
    batches = [turns[i::1][j : j + 60] for i in (0,) for j in range(0, len(turns), 60)]
    again = [[*b, *draw.sample(b, 5)] for b in batches]
    rows, held = play(spark, tmp_path, again, "48 hours")
    watermark = max(t[1] for t in turns) - timedelta(hours=48)
    expected = conversation.session_state(spark.createDataFrame(turns, TURNS)).where(F.col("ended") + F.expr("INTERVAL 24 HOURS") < F.lit(watermark))
    assert plain(rows) == plain(expected.collect()) and len(rows) > 20
    assert max(held) < len(turns) and held[-1] == len(turns) - sum(r.turns for r in rows)


def test_batch_cases(spark):
    rows = [turn(1, 0, 1), turn(1, 24, 2, "a", "i"), turn(1, 48.5, 3, None, "i"), (None, START, 1, "n", None, False), (2, None, 1, "n", None, False), (2, START, None, "n", None, False), (4, START, 1, None, None, None)]
    got = plain(conversation.session_state(spark.createDataFrame(rows, TURNS)).collect())
    hour = lambda h: START + timedelta(hours=h)
    assert got == [("1", hour(0), hour(24), 2, "a", ("i",)), ("1", hour(48.5), hour(48.5), 1, None, ("i",)), ("4", START, START, 1, None, ())]
