"""Matching of names by containment and by scores, without nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text

#: Characters of the pieces that containment is found by.
PIECE = 3


def containing(parts: DataFrame, part: str, wholes: DataFrame, whole: str) -> DataFrame:
    """parts joined with wholes where `whole` contains `part`, as text; empty parts meet nothing.

    A text that contains another holds its first PIECE characters (or all of it), so the two meet on equal pieces first. Both tables are best distinct.
    """
    first = parts.where(F.length(part) > 0).withColumn("piece_", F.substring(part, 1, PIECE))
    cut = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(PIECE)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(whole) - n + 1, F.lit(1))), lambda i: F.substring(F.col(whole), i, n))))
    pieces = wholes.where(F.length(whole) > 0).withColumn("piece_", F.explode(F.array_distinct(cut)))
    return first.join(pieces, "piece_").where(F.contains(F.col(whole), F.col(part))).drop("piece_")


def _tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda w: F.length(w) > 2)


def fuzzy_courses(terms: DataFrame, courses: DataFrame, least: float = 50.0, sure: float = 80.0, most: int = 3) -> DataFrame:
    """(term, rank, name, score): up to three names for a term: 100 for an equal name or acronym, 90 if the name contains the term, 85 the other way round, else
    10 * (15 * equal words + 5 * words contained in one another) / the longer number of words of over two letters; ties by name.

    The two best names stay if they reach `least`, a third only if it is `sure`. Plural endings don't count. terms: (term); courses: (name, acronym), of which distinct ones are matched.
    """
    low = lambda c: F.trim(F.lower(c))
    stem = lambda c: F.regexp_replace(c, r"(\w)s\b", "$1")
    asked = terms.select("term").distinct().select("term", low("term").alias("t")).where("t <> ''").withColumn("ts", stem(F.col("t")))
    known = courses.select("name", F.lower("acronym").alias("acronym")).distinct().withColumn("n", low("name")).where("n <> ''").withColumn("ns", stem(F.col("n")))
    by = known.drop("acronym").distinct()
    scored = asked.join(known, asked["t"] == known["acronym"]).select("term", "name", F.lit(100.0).alias("score"))
    for one, two in (("t", "n"), ("ts", "ns")):
        scored = scored.unionAll(asked.join(by, asked[one] == by[two]).select("term", "name", F.lit(100.0)))
        scored = scored.unionAll(containing(asked.select("term", one), one, by.select("name", two), two).select("term", "name", F.lit(90.0)))
        scored = scored.unionAll(containing(by.select("name", two), two, asked.select("term", one), one).select("term", "name", F.lit(85.0)))
    # pairs that share a word or a part of one
    a = asked.select("term", F.explode(F.array_distinct(_tokens(F.col("ts")))).alias("x"), _tokens(F.col("ts")).alias("tw"))
    b = by.select("name", F.explode(F.array_distinct(_tokens(F.col("ns")))).alias("y"), _tokens(F.col("ns")).alias("nw"))
    words_a, words_b = a.select("x").distinct(), b.select("y").distinct()
    near = containing(words_a, "x", words_b, "y").unionByName(containing(words_b, "y", words_a, "x").select("x", "y")).distinct()
    pairs = near.join(a, "x").join(b, "y").select("term", "name", "tw", "nw").distinct()
    equal = F.size(F.filter("tw", lambda w: F.array_contains("nw", w)))
    held = F.size(F.filter("tw", lambda w: F.exists("nw", lambda v: v.contains(w) | w.contains(v))))
    ratio = (equal * 15 + (held - equal) * 5) / F.greatest(F.size("tw"), F.size("nw")) * 10
    scored = scored.unionAll(pairs.select("term", "name", F.least(ratio, F.lit(84.0)).alias("score")))
    top = scored.groupBy("term", "name").agg(F.round(F.max("score"), 6).alias("score")).where(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("score"), "name"))
    return top.withColumn("rank", rank).where((F.col("rank") <= 2) | ((F.col("rank") <= most) & (F.col("score") >= sure))).select("term", "rank", "name", "score")


def by_person(people: DataFrame, texts: DataFrame, most: int = 10) -> DataFrame:
    """(person, rank, item): the items whose text names a person, in full or by a last name of over four letters; by item, at most `most`.

    people: (person); texts: (item, text). Words and runs of words are met by equal keys, so a text is read once whatever the number of people.
    """
    who = people.select("person", F.lower("person").alias("p")).distinct()
    long = F.filter(F.split("p", " "), lambda w: F.length(w) > 3)
    last = F.element_at(long, -1)
    keys = who.select("person", F.col("p").alias("key")).unionAll(who.where(F.size(long) > 0).select("person", last).where(F.length(last) > 4)).distinct()
    found = containing(keys, "key", texts.select("item", F.lower("text").alias("low")), "low").select("person", "item").distinct()
    rank = F.row_number().over(Window.partitionBy("person").orderBy("item"))
    return found.withColumn("rank", rank).where(F.col("rank") <= most).select("person", "rank", "item")


def display_case(c: Column | str, small: tuple[str, ...] = ("de", "da", "do", "das", "dos", "e", "em", "para")) -> Column:
    """A term as it is shown: as it is if it has a capital, in capitals if it is one word of up to four letters, else with capitals but for small words after the first."""
    said = F.trim(text.col(c))
    words = F.transform(F.split(said, r"\s+"), lambda w, i: F.when((i > 0) & w.isin(*small), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))))
    return F.when((said == "") | (said != F.lower(said)), said).when((F.length(said) <= 4) & said.rlike(r"^\p{L}+$"), F.upper(said)).otherwise(F.array_join(words, " "))


def blocked_programme(c: Column | str, names: tuple[str, ...] = ("institute",)) -> Column:
    """Whether a name is no programme of its own: up to two letters, or the institute's name, alone or at either end."""
    key = text.graph_key(c)
    any_ = "|".join(names)
    return (F.length(key) <= 2) | key.rlike(rf"^(?:{any_})(?: |$)| (?:{any_})$")
