"""Which course may come before another, by the terms it has in programmes, and the base of a course by the concepts it requires."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.lineage import Rounds, checkpoint, shuffled

#: Courses that cover a concept, best first, that are tried for it in the first round; each further round tries eight times as many.
TRIED = 16
#: The term by which courses without one are ranked.
NO_TERM = 99


def allowed(pairs: DataFrame, places: DataFrame) -> DataFrame:
    """The pairs (course, before) in which `before` has a smaller term in some programme of both, or no programme of both has terms for both.

    places: (course, programme, term), several a course; an elective has no term. Pairs meet places by course and programme, so a large programme isn't paired within itself.
    """
    known = places.where("programme IS NOT NULL AND term IS NOT NULL").select("course", "programme", "term")
    own = pairs.select("course", "before").distinct().join(shuffled(known), "course")
    other = known.toDF("before", "programme", "term_before")
    met = own.join(shuffled(other), ["before", "programme"]).groupBy("course", "before").agg(F.bool_or(F.col("term_before") < F.col("term")).alias("earlier"))
    return pairs.join(shuffled(met.where("NOT earlier")), ["course", "before"], "left_anti")


def base_of_concepts(requires: DataFrame, covers: DataFrame, closure: DataFrame, places: DataFrame, courses: DataFrame, n: int = 6) -> DataFrame:
    """(course, rank, base, confidence, concepts): courses that cover what a course requires and its prerequisites don't.

    requires, covers: (course, concept, conf); closure: (node, ancestor), or (node, concept) with the required ones that an ancestor covers, as from closure.inherited; places: (course, programme, term); courses: (course, name, term). A required concept that an ancestor covers
    asks for nothing. Of the others that cover it, not being the course itself, and that may come before it, the one of the highest confidence counts, ties to the smaller term, then name, then id.
    A concept's courses are tried in that order, some more in each round, for what is still without one; so a common concept doesn't pair all that require it with all that cover it.
    """
    rounds = Rounds(requires.sparkSession)
    need = requires.groupBy("course", "concept").agg(F.max("conf").alias("need"))
    give = covers.groupBy("course", "concept").agg(F.max("conf").alias("give"))
    if "concept" in closure.columns:
        taken = closure.select(F.col("node").alias("course"), "concept")
    else:
        above = closure.select(F.col("node").alias("course"), F.col("ancestor").alias("above")).distinct()
        taken = need.select("course", "concept").join(shuffled(above), "course").join(shuffled(give.select(F.col("course").alias("above"), "concept")), ["above", "concept"], "left_semi").select("course", "concept")
    left = rounds.keep("left", need.join(shuffled(taken), ["course", "concept"], "left_anti"))
    known = courses.select(F.col("course").alias("base"), "name", F.col("term").alias("base_term"))
    by = [F.desc("give"), F.coalesce("base_term", F.lit(NO_TERM)), F.coalesce("name", F.col("base").cast("string")), "base"]
    rated = rounds.keep("rated", give.withColumnRenamed("course", "base").join(shuffled(known), "base", "left"))
    most, tried, parts = TRIED, 0, 0
    found = left.where("false").select("course", "concept", "need", F.lit(None).cast(rated.schema["base"].dataType).alias("base"), F.lit(None).cast("double").alias("give"))
    while not left.isEmpty():
        ranked = rated.join(left.select("concept").distinct(), "concept", "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("concept").orderBy(*by))).where(F.col("r") <= most)
        best = rounds.keep("best", ranked)
        pairs = left.join(best.where(F.col("r") > tried), "concept").where("course <> base")
        free = allowed(pairs.withColumnRenamed("base", "before"), places).withColumnRenamed("before", "base")
        top = free.groupBy("course", "concept", "need").agg(F.min_by(F.struct("base", "give"), "r").alias("t")).select("course", "concept", "need", "t.base", F.col("t.give").cast("double").alias("give"))
        found, parts = found.unionAll(rounds.keep(f"found{parts}", top)), parts + 1
        more = best.where(F.col("r") == most).select("concept")
        left = rounds.keep("left", left.join(more, "concept", "left_semi").join(found.select("course", "concept"), ["course", "concept"], "left_anti"))
        tried, most = most, most * 8
    score = F.least("need", "give")
    merged = found.groupBy("course", "base").agg(F.max(score).alias("confidence"), F.array_join(F.array_sort(F.collect_set("concept")), ",").alias("concepts")).join(known, "base", "left")
    rank = F.row_number().over(Window.partitionBy("course").orderBy(F.desc("confidence"), F.coalesce("name", F.col("base").cast("string")), "base"))
    out = checkpoint(merged.withColumn("rank", rank).where(F.col("rank") <= n).select("course", "rank", "base", "confidence", "concepts"))
    rounds.done()
    return out
