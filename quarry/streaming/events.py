"""Structured Streaming twins of the batch operators: counts, deduplication, sessions, and entities carried per conversation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
TURNS = "conv_id long, turn long, role string, text string"


def read(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """New Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(hour, event_type, n): counts by window; events later than the watermark are left out."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return by.select(F.col("w.start").alias("hour"), "event_type", "n")


def distinct_events(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event_id once, with state that the watermark bounds."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def sessions(events: DataFrame, gap: str = "24 hours", late: str = "2 hours") -> DataFrame:
    """(user_id, session_start, session_end, events): closed once the watermark passes their end."""
    by = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"))
    return by.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def carried(turns: DataFrame, pattern: str = "([a-z]{9,})") -> DataFrame:
    """(conv_id, turn, entity): the entity in force at each turn; state is one string and the last turn per conversation.

    Turns of a batch are put in order; a turn that comes after a later one was handled only sees state, and doesn't change it.
    """
    import re

    find = re.compile(pattern).search

    def step(key: tuple[int], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, entity = state.get if state.exists else (-1, "")
        rows = pd.concat(list(frames)).sort_values("turn")
        out = []
        for turn, said in zip(rows["turn"], rows["text"], strict=True):
            own = find((said or "").lower())
            shown = own.group(1) if own else entity
            if turn > last:
                last, entity = int(turn), shown
            out.append((key[0], int(turn), shown or None))
        state.update((last, entity))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "entity"])

    return turns.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, turn long, entity string", "last long, entity string", "append", GroupStateTimeout.NoTimeout)


def run(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Take in what there is and write it as Parquet; a restart goes on from the checkpoint."""
    return stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
