"""Conversation state as windows over turns (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text

#: Folded phrases that show a missed answer.
MISS = ("nao encontrei", "nao tenho esse dado", "nao consegui identificar")
#: Folded patterns of a reference back.
BACK = (
    r"\b(?:ele|ela|eles|elas)\b", r"\b(?:isso|isto|aquilo)\b", r"\b(?:esse|essa|esses|essas) (?:[^d]|d[^e]|de\S)", r"\b(?:qual|quais) (?:deles|delas)\b", r"\b(?:dela|dele|delas|deles)\b",
    r"\b(?:dess[ae]s?|ness[ae]s?|daquel[ea]s?|naquel[ea]s?)\b", r"\bnel[ea]s?\b", r"^ *e \w",
)


def history(turns: DataFrame, last: int = 6, size: int = 350) -> DataFrame:
    """(conv_id, turns, history): the last turns of user and assistant as lines of role and text, cut at words."""
    line = F.concat("role", F.lit(": "), text.truncate_words(text.squeeze("text"), size))
    spoken = turns.where("role IN ('user', 'assistant')").withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role")))
    kept = spoken.where(F.col("r") <= last).withColumn("line", line)
    return kept.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("r")).alias("o"), "line"))), lambda s: s["line"]), "\n").alias("history"))


def carried(turns: DataFrame, entity: Column) -> DataFrame:
    """Turns with the entity that holds at each: its own, else the last one mentioned before."""
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("own_entity", entity).withColumn("entity", F.last("own_entity", ignorenulls=True).over(order))


def pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): user turns with the assistant's turn that follows at once."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    found = turns.withColumns({"next_role": F.lead("role").over(order), "answer": F.lead("text").over(order)})
    return found.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def missed(c: Column | str, phrases: tuple[str, ...] = MISS) -> Column:
    """Whether an answer says that nothing was found."""
    said = text.text_key(c)
    return F.coalesce(said.rlike("|".join(phrases)), F.lit(False))


def ambiguous(c: Column | str, patterns: tuple[str, ...] = BACK) -> Column:
    """Short or refers back; not if it names an acronym, or a name in capitals after 'de', 'sobre' or 'para', or only goes on to another topic."""
    raw, said = F.trim(text.col(c)), text.text_key(c)
    named = said.rlike(r"^e (?:de|sobre) [a-z]") | raw.rlike(r"\b[A-Z]{2,}\b") | raw.rlike(r"(?:de|sobre|para) [A-Z][a-zà-ú]+(?: [A-Za-zÀ-ú]+)?(?:\?|,| +quais?)")
    return ~named & ((F.size(F.split(raw, r"\s+")) < 4) | said.rlike("|".join(patterns)))


def compound(c: Column | str) -> Column:
    """At least 25 characters and several questions or a joining phrase."""
    return (F.length(text.col(c)) >= 25) & ((F.regexp_count(text.col(c), F.lit(r"\?")) >= 2) | text.phrase(c, "and also", "as well as"))


def sessions(events: DataFrame, gap: str = "24 hours") -> DataFrame:
    """(user_id, session_start, session_end, events): runs of a user's events with no longer gap. events: (user_id, ts)."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events")).select(
        "user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events"
    )


def most_recent(sessions_: DataFrame, n: int = 1000) -> DataFrame:
    """(user_id, last): the n users of the latest activity, ties to the smaller id: what a bounded store would keep."""
    return sessions_.groupBy("user_id").agg(F.max("session_end").alias("last")).orderBy(F.desc("last"), "user_id").limit(n)


def accumulate(events: DataFrame, item: Column, reset: Column) -> DataFrame:
    """(user_id, epoch, items): distinct items since the user's last reset. events: (user_id, ts, event_id)."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    marked = events.withColumn("is_reset", reset).withColumn("epoch", F.sum(F.col("is_reset").cast("long")).over(order)).withColumn("item", item)
    return marked.where("NOT is_reset").groupBy("user_id", "epoch").agg(F.countDistinct("item").alias("items"))


def session_state(turns: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """(key, started, ended, turns, entity, items): sessions of a key, where a turn later than ttl after the one before starts a new one; the last entity named, and the different items
    since the last reset, its own included, in the order of their first mention. turns: (key, at, number, entity, item, reset), each known by its key and number: of repeated ones the earliest counts."""
    some = turns.where("key IS NOT NULL AND number IS NOT NULL AND at IS NOT NULL").groupBy("key", "number").agg(F.min(F.struct("at", "entity", "item", F.coalesce("reset", F.lit(False)).alias("reset"))).alias("t"))
    rows = some.select(F.col("key").cast("string").alias("key"), "number", "t.*")
    order = Window.partitionBy("key").orderBy("at", "number")
    far = F.col("at") > F.lag("at").over(order) + F.expr(f"INTERVAL {ttl}")
    sofar = order.rowsBetween(Window.unboundedPreceding, 0)
    cut = rows.withColumn("new", F.coalesce(far, F.lit(True)).cast("long")).withColumn("session", F.sum("new").over(sofar))
    inside = Window.partitionBy("key", "session").orderBy("at", "number").rowsBetween(Window.unboundedPreceding, 0)
    marked = cut.withColumn("epoch", F.sum(F.col("reset").cast("long")).over(inside))
    place = F.struct("at", "number")
    items = F.collect_list(F.when(F.col("item").isNotNull(), F.struct("epoch", "at", "number", "item")))
    by = marked.groupBy("key", "session").agg(
        F.min("at").alias("started"), F.max("at").alias("ended"), F.count("*").alias("turns"), F.max("epoch").alias("last"),
        F.max_by("entity", F.when(F.col("entity").isNotNull(), place)).alias("entity"), F.array_sort(items).alias("i"),
    )
    kept = F.array_distinct(F.transform(F.filter("i", lambda x: x["epoch"] == F.col("last")), lambda x: x["item"]))
    return by.select("key", "started", "ended", "turns", "entity", kept.alias("items"))
