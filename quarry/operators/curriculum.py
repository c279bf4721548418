"""Curriculum operators: listed courses, programme matching, teachers by topic, study tracks, controlled vocabularies, context headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.lineage import shuffled
from quarry.operators.names import containing


def flag_listed(courses: DataFrame, listed: DataFrame) -> DataFrame:
    """(course, code, name, listed): a course is listed by its code, else by its normalised name; listed ones that no course matches are
    added with a null course. courses: (course, code, name); listed: (code, name), code may be null."""
    keyed = courses.withColumn("key", text.graph_key("name"))
    wanted = listed.select(F.col("code").alias("lcode"), F.col("name").alias("lname"), text.graph_key("name").alias("lkey"))
    codes = wanted.where("lcode IS NOT NULL").select("lcode").distinct().withColumn("by_code", F.lit(True))
    names = wanted.select("lkey").distinct().withColumn("by_name", F.lit(True))
    marked = keyed.join(codes, keyed["code"] == codes["lcode"], "left").join(names, keyed["key"] == names["lkey"], "left")
    flagged = marked.select("course", "code", "name", F.coalesce("by_code", "by_name", F.lit(False)).alias("listed"))
    known = keyed.select("key").distinct()
    new = wanted.join(keyed.select("code").where("code IS NOT NULL").distinct(), F.col("lcode") == F.col("code"), "left_anti").join(known, F.col("lkey") == F.col("key"), "left_anti")
    return flagged.unionByName(new.selectExpr("cast(NULL AS long) AS course", "lcode AS code", "lname AS name", "true AS listed").distinct())


def match_programmes(terms: DataFrame, programmes: DataFrame, aliases: DataFrame) -> DataFrame:
    """(term, programme): by acronym or alias, else the smallest programme whose normalised name holds the term or is held by it (over three letters).

    terms: (term); programmes: (programme, acronym), a dimension; aliases: (alias, acronym), fixed and small.
    """
    asked = terms.select("term", text.graph_key("term").alias("k")).where("k <> ''").distinct()
    short = aliases.select(text.graph_key("alias").alias("k"), F.upper("acronym").alias("acronym"))
    resolved = asked.join(F.broadcast(short), "k", "left").select("term", "k", F.coalesce("acronym", F.upper("k")).alias("a"))
    known = programmes.select("programme", F.upper("acronym").alias("acronym"), text.graph_key("programme").alias("pk"))
    exact = resolved.join(known, F.col("a") == F.col("acronym")).groupBy("term").agg(F.min("programme").alias("programme"))
    rest = resolved.join(exact.select("term"), "term", "left_anti").where("length(k) > 3")
    both = containing(rest, "k", known, "pk").select("term", "programme").unionAll(containing(known, "pk", rest, "k").select("term", "programme"))
    loose = both.groupBy("term").agg(F.min("programme").alias("programme"))
    return exact.unionAll(loose)


def teachers_by_topic(topics: DataFrame, experts: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(topic, teacher): teachers with an area that holds all (singular) words of the topic or of a synonym of it.

    topics: (topic); experts: (teacher, area); synonyms: (topic, synonym), fixed and small. Distinct areas, not teachers, are matched.
    """
    words = lambda c: F.array_distinct(F.transform(F.split(text.graph_key(c), " "), text.singular))
    asked = topics.select("topic", F.col("topic").alias("said")).unionAll(topics.join(F.broadcast(synonyms), "topic").select("topic", "synonym"))
    wanted = asked.select("topic", words("said").alias("w")).where("w[0] <> ''")
    need = wanted.withColumn("n", F.size("w")).withColumn("variant", F.xxhash64("w")).select("topic", "variant", "n", F.explode("w").alias("word"))
    held = experts.select("area").distinct().select("area", F.explode(words("area")).alias("word"))
    match = need.join(held, "word").groupBy("topic", "variant", "n", "area").agg(F.count("*").alias("c")).where("c = n").select("topic", "area").distinct()
    return match.join(experts, "area").select("topic", "teacher").distinct()


def tracks(mentions: DataFrame, covers: DataFrame, elective: DataFrame, most: int = 4) -> DataFrame:
    """(id, concept, courses, electives, first): for the up to `most` longest concepts of a text, the courses that cover each.

    mentions: (id, name, rank) as from graph.mentions; covers: (concept, course); elective: (course).
    """
    kept = mentions.where(F.col("rank") <= most).select("id", F.col("name").alias("concept"))
    marked = covers.join(elective.select("course").distinct().withColumn("e", F.lit(1)), "course", "left")
    per = marked.groupBy("concept").agg(F.countDistinct("course").alias("courses"), F.countDistinct(F.when(F.col("e") == 1, F.col("course"))).alias("electives"), F.min("course").alias("first"))
    return kept.join(per, "concept").select("id", "concept", "courses", "electives", "first")


def controlled(found: DataFrame, vocabulary: DataFrame, clamp: float = 0.8) -> DataFrame:
    """(item, term, confidence, known): extracted terms against a vocabulary; confidences clamped to 0..clamp, the best of each. found: (item, term, confidence)."""
    best = found.select("item", text.graph_key("term").alias("term"), F.least(F.greatest("confidence", F.lit(0.0)), F.lit(clamp)).alias("confidence")).where("term <> ''")
    one = best.groupBy("item", "term").agg(F.max("confidence").alias("confidence"))
    words = vocabulary.select(text.graph_key("term").alias("term")).distinct().withColumn("known", F.lit(True))
    return one.join(words, "term", "left").select("item", "term", "confidence", F.coalesce("known", F.lit(False)).alias("known"))


def source_headers(c: Column | str) -> Column:
    """Lines in brackets, each once, in order."""
    return F.array_distinct(F.regexp_extract_all(text.col(c), F.lit(r"(?m)^(\[[^\]\n]+\])"), 1))


def with_prefix(c: Column | str, model: Column | str, query: bool) -> Column:
    """A text with the task prefix of its embedding model; models without one get none."""
    name = F.lower(text.col(model))
    prefix = F.when(name.contains("nomic"), F.lit("search_query: " if query else "search_document: ")).when(name.contains("e5"), F.lit("query: " if query else "passage: ")).otherwise("")
    return F.concat(prefix, text.col(c))


def section_for(question: Column | str, rules: list[tuple[str, tuple[str, ...]]], default: str) -> Column:
    """The section that a question asks for, by the first rule it meets."""
    found = F.lit(default)
    for name, phrases in reversed(rules):
        found = F.when(text.phrase(question, *phrases), name).otherwise(found)
    return found


def enrichment(similar: DataFrame, predicted: DataFrame) -> DataFrame:
    """(course, note): a line on similar courses and one on likely missing prerequisites. similar: (course, rank, similar, score); predicted: (course, prereq, share)."""
    one = similar.groupBy("course").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "similar"))), lambda s: s["similar"].cast("string")), ", ").alias("s"))
    two = predicted.groupBy("course").agg(F.array_join(F.array_sort(F.collect_set(F.col("prereq").cast("string"))), ", ").alias("p"))
    note = F.concat_ws("\n", F.concat(F.lit("Similar: "), F.col("s")), F.concat(F.lit("Likely needs: "), F.col("p")))
    return one.join(shuffled(two), "course", "full_outer").select("course", note.alias("note"))


def source_counts(chunks: DataFrame) -> DataFrame:
    """(sources, chunks): how many distinct sources an index holds, and chunks."""
    return chunks.agg(F.countDistinct("source").alias("sources"), F.count("*").alias("chunks"))


def latest_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("r = 1").drop("r")


def overview(courses: DataFrame, electives: DataFrame, coordinators: DataFrame) -> DataFrame:
    """(programme, section, item, courses, credits, names): what a programme offers: a row for each term (section term), each group of electives (electives) and the whole (total), with its
    coordinators as names. courses: (programme, term, course, name, credits), without a term where it isn't fixed; electives: (programme, group, course, name, credits); coordinators: (programme, name)."""
    totals = F.countDistinct("course").alias("courses"), F.sum("credits").cast("long").alias("credits")
    listed = F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("names")
    terms = courses.where("term IS NOT NULL").groupBy("programme", F.col("term").cast("string").alias("item")).agg(*totals, listed)
    groups = electives.groupBy("programme", F.col("group").cast("string").alias("item")).agg(*totals, listed)
    whole = courses.where("term IS NOT NULL").groupBy("programme").agg(*totals)
    led = coordinators.groupBy("programme").agg(listed)
    total = whole.join(led, "programme", "left").select("programme", F.lit("total"), F.lit(""), "courses", "credits", F.coalesce("names", F.lit("")))
    rows = lambda df, section: df.select("programme", F.lit(section).alias("section"), "item", "courses", "credits", "names")
    return rows(terms, "term").unionAll(rows(groups, "electives")).unionAll(total)
