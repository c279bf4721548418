"""Keyed state with event-time timers: sessions of a conversation that expire, with the entity in force and the items gathered since the last reset.

State is one map a key, of the turns of its open sessions, without their texts, and at most one timer, at the time the first open session can close. Turns are kept until the watermark has passed
their session's end, so neither their order of arrival nor a repeated turn changes a result; a closed session's turns leave the state. A turn behind the watermark is dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What state of this kind needs: Spark's default store has no timers.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
SESSIONS = "key string, started timestamp, ended timestamp, turns long, entity string, items array<string>"
#: The same with times as microseconds, which no session's time zone changes on their way through pandas.
_FOUND = SESSIONS.replace("timestamp", "long")


def use_store(spark: SparkSession) -> None:
    spark.conf.set(*STORE)


class Sessions(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getMapState("turns", "number long", "micros long, entity string, item string, reset boolean")
        self.due = handle.getValueState("due", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for number, micros, entity, item, reset in zip(frame["number"], frame["micros"], frame["entity"], frame["item"], frame["reset"], strict=True):
                if not self.turns.containsKey((int(number),)):
                    self.turns.updateValue((int(number),), (int(micros), entity, item, bool(reset)))
        self._await(self._sessions())
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # turns from here on are no older than the watermark, and sessions may be closed that end before it by more than the limit
        watermark, sessions = timerValues.getCurrentWatermarkInMs(), self._sessions()
        closed = [s for s in sessions if self._due(s) <= watermark]
        for session in closed:
            for _, number, *_ in session:
                self.turns.removeKey((number,))
        self.due.clear()
        self._await(sessions[len(closed) :])
        if closed:
            yield pd.DataFrame([(key[0], *summary(s)) for s in closed], columns=["key", "started", "ended", "turns", "entity", "items"])

    def _sessions(self) -> list[list[tuple]]:
        """Turns (micros, number, entity, item, reset) in order, cut where one comes later than the limit after the one before."""
        out: list[list[tuple]] = []
        for turn in sorted(((v[0], k[0], *v[1:]) for k, v in self.turns.iterator()), key=lambda t: t[:2]):
            if not out or turn[0] - out[-1][-1][0] > 1000 * self.ttl:
                out.append([])
            out[-1].append(turn)
        return out

    def _due(self, session: list[tuple]) -> int:
        """The first millisecond at which no turn that may still come belongs to it."""
        return session[-1][0] // 1000 + self.ttl + 1

    def _await(self, sessions: list[list[tuple]]) -> None:
        due = self._due(sessions[0]) if sessions else None
        old = self.due.get()[0] if self.due.exists() else None
        if due != old:
            if old is not None:
                self.handle.deleteTimer(old)
            if due is not None:
                self.handle.registerTimer(due)
                self.due.update((due,))


def summary(session: list[tuple]) -> tuple:
    entity, items = None, {}
    for _, _, own, item, reset in session:
        entity = entity if own is None else own
        if reset:
            items = {}
        if item is not None:
            items[item] = None
    return session[0][0], session[-1][0], len(session), entity, list(items)


def sessions(turns: DataFrame, ttl: str = "24 hours", late: str = "2 hours") -> DataFrame:
    """(key, started, ended, turns, entity, items) of each session once it has expired: the watermark is later than its last turn by more than ttl.

    turns: a stream of (key, at, number, entity, item, reset); a turn is known by its key and number, and rows without these or without a time are dropped. entity: the last one named; items: the
    different ones since the last reset, its own included, in the order of their first mention. The session needs use_store().
    """
    ms = int(pd.Timedelta(ttl).total_seconds() * 1000)
    some = turns.where("key IS NOT NULL AND number IS NOT NULL AND at IS NOT NULL")
    rows = some.select(F.col("key").cast("string").alias("key"), "at", F.unix_micros("at").alias("micros"), F.col("number").cast("long").alias("number"), "entity", "item", F.coalesce("reset", F.lit(False)).alias("reset"))
    found = rows.withWatermark("at", late).groupBy("key").transformWithStateInPandas(Sessions(ms), _FOUND, "Append", "eventTime")
    return found.withColumns({c: F.timestamp_micros(c) for c in ("started", "ended")})


def open_turns(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, number, micros, entity, item, reset): what the state holds after the last batch, read from the query's checkpoint."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "turns").load()
    return state.select("key.key", "user_map_key.number", "user_map_value.*")
