"""Names found in texts as spans that don't nest, and terms grounded in a graph stage by stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.lineage import checkpoint, shuffled
from quarry.operators import graph
from quarry.operators.names import containing


def spans(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(id, target, key, first, last): where each name stands in a text as whole words, by the places of its first and last word.

    texts: (id, text), the id of one text each; names: (name, target). Texts are cut into runs of as many words as names have, so names are found by an equi-join; several targets of a name give a
    row each. Stop-words and punctuation count for nothing on either side.
    """
    keyed = names.select(text.graph_key("name").alias("key"), "target").where("key <> ''").distinct()
    return _standing(texts, keyed).select("id", "target", "key", "first", "last")


def _standing(texts: DataFrame, keyed: DataFrame) -> DataFrame:
    """The spans (id, key, first, last, ...) of keys in texts, with what else keyed (key, ...) has."""
    words = texts.select("id", F.split(text.graph_key("text"), " ").alias("w")).where("w[0] <> ''")
    sized = keyed.withColumn("n", F.size(F.split("key", " ")))
    lengths = sized.agg(F.collect_set("n").alias("lengths"))  # one row, as many as the longest name has words at most
    runs = words.crossJoin(F.broadcast(lengths)).select("id", "w", F.explode(F.expr("filter(lengths, n -> n <= size(w))")).alias("n"))
    found = runs.select("id", F.col("n").alias("length"), F.posexplode(F.expr("transform(sequence(1, size(w) - n + 1), i -> array_join(slice(w, i, n), ' '))")).alias("first", "key"))
    return found.join(keyed, "key").withColumn("last", F.col("first") + F.col("length") - 1).drop("length")


def _bounds(names: DataFrame) -> DataFrame:
    """(key, target, most): the least and the greatest target of each name, which is one row for a name that many have."""
    return names.select(text.graph_key("name").alias("key"), "target").where("key <> ''").groupBy("key").agg(F.min("target").alias("target"), F.max("target").alias("most"))


def outermost(found: DataFrame) -> DataFrame:
    """The spans (id, first, last, ...) that don't lie within a longer one of their text; equal spans and overlapping ones stay.

    A sweep over each text's spans by their start, longer ones first: a span lies within another if an earlier one of the sweep, not the same span, reaches as far.
    """
    one = found.select("id", "first", "last").distinct()
    before = Window.partitionBy("id").orderBy("first", F.desc("last")).rowsBetween(Window.unboundedPreceding, -1)
    kept = one.withColumn("reach", F.max("last").over(before)).where("reach IS NULL OR reach < last").drop("reach")
    return found.join(shuffled(kept), ["id", "first", "last"])


def own_words(people: DataFrame, least: int = 4) -> DataFrame:
    """(name, target): the words of a person's name, of `least` letters or more, that no other person's has. people: (name, target)."""
    words = people.select("target", F.explode(F.array_distinct(F.split(text.graph_key("name"), " "))).alias("name")).where(F.length("name") >= least)
    return words.groupBy("name").agg(F.countDistinct("target").alias("holders"), F.min("target").alias("target")).where("holders = 1").drop("holders")


def longest(found: DataFrame) -> DataFrame:
    """(id, target): for each text the target of its longest name, ties to the first in the text, then to the smaller target."""
    return found.groupBy("id").agg(F.min_by("target", F.struct(-F.length("key"), F.col("first"), F.col("target"))).alias("target"))


def ground(questions: DataFrame, nodes: DataFrame, keys: dict[str, Column], names: DataFrame | None = None, aliases: DataFrame | None = None, share_word: bool = False) -> DataFrame:
    """(id, term, node_id, how): each question's term in the graph, and the stage that found it: key, part, mention, alias or none.

    questions: (id, text, term); nodes: (node_id, name, ...). First by an exact key (keys as in graph.lookup_table); then the first node (smallest id) whose name contains the term, and, with
    share_word, has one of its words; then the longest name that the question itself mentions, names within longer ones left out; then what all aliases in it agree on. Each stage works on what the
    one before left. names: (name, target) to be looked for in questions, those of the nodes by default; aliases: the same, own_words() of people, say, none by default.
    """
    asked = checkpoint(questions.select("id", "text", "term", text.graph_key(F.coalesce("term", F.lit(""))).alias("key")))
    table = graph.lookup_table(nodes, keys)
    first = asked.join(shuffled(table.withColumnRenamed("key", "known")), F.col("key") == F.col("known"), "left")
    by_key = first.where("node_id IS NOT NULL").select("id", "term", "node_id", F.lit("key").alias("how"))
    rest = checkpoint(first.where("node_id IS NULL").select("id", "text", "term", "key"))
    # only the smallest node of a name counts, so names meet terms once, whatever the number of nodes that have them
    held = nodes.groupBy(text.graph_key("name").alias("name_key")).agg(F.min("node_id").alias("other"))
    pairs = containing(rest.where("key <> ''").select("key").distinct(), "key", held, "name_key")
    if share_word:
        pairs = pairs.where(F.arrays_overlap(F.split("key", " "), F.split("name_key", " ")))
    part = pairs.groupBy(F.col("key").alias("of")).agg(F.min("other").alias("node_id"))
    second = checkpoint(rest.join(shuffled(part), F.col("key") == F.col("of"), "left"))
    by_part = second.where("node_id IS NOT NULL").select("id", "term", "node_id", F.lit("part").alias("how"))
    left = second.where("node_id IS NULL").select("id", "text", "term")
    wanted = nodes.select("name", F.col("node_id").alias("target")) if names is None else names
    seen = longest(outermost(_standing(left.select("id", "text"), _bounds(wanted)))).withColumnRenamed("target", "node_id")
    third = left.join(shuffled(seen), "id", "left")
    if aliases is None:
        return by_key.unionAll(by_part).unionAll(third.select("id", "term", "node_id", F.when(F.col("node_id").isNotNull(), "mention").otherwise("none").alias("how")))
    third = checkpoint(third)
    by_mention = third.where("node_id IS NOT NULL").select("id", "term", "node_id", F.lit("mention").alias("how"))
    rest = third.where("node_id IS NULL").select("id", "text", "term")
    agreed = _standing(rest.select("id", "text"), _bounds(aliases)).groupBy("id").agg(F.min("target").alias("node_id"), F.max("most").alias("most")).where("node_id = most").drop("most")
    last = rest.join(shuffled(agreed), "id", "left").select("id", "term", "node_id", F.when(F.col("node_id").isNotNull(), "alias").otherwise("none").alias("how"))
    return by_key.unionAll(by_part).unionAll(by_mention).unionAll(last)


def track_support(concepts: DataFrame, covers: DataFrame, base: DataFrame, experts: DataFrame, best: int = 2) -> DataFrame:
    """(id, kind, item, detail): what a track of study rests on: 'base' courses with the concepts they lead to, and 'specialist' teachers with their areas.

    concepts: (id, concept) of each track; covers: (concept, course); base: (course, base, rank), of which the `best` count; experts: (teacher, area). A base that covers a concept of the track
    itself is left out. A teacher's area fits if its key contains that of a concept of over three letters, or is contained in it. Bases meet tracks by concept, so courses aren't paired with tracks.
    """
    by_concept = covers.join(base.where(F.col("rank") <= best).select("course", "base"), "course").select("concept", "base").distinct()
    reached = concepts.join(by_concept, "concept")
    own = covers.toDF("own", "base").join(concepts.toDF("id", "own"), "own").select("id", "base").distinct()
    bases = reached.join(own, ["id", "base"], "left_anti").groupBy("id", F.col("base").cast("string").alias("item")).agg(F.array_join(F.array_sort(F.collect_set("concept")), ",").alias("detail"))
    keys = concepts.select("concept").distinct().select("concept", text.graph_key("concept").alias("ck")).where("length(ck) > 3")
    areas = experts.select("area").distinct().select("area", text.graph_key("area").alias("ak")).where("ak <> ''")
    fits = containing(keys, "ck", areas, "ak").select("concept", "area").unionAll(containing(areas, "ak", keys, "ck").select("concept", "area")).distinct()
    teachers = concepts.join(fits, "concept").join(experts, "area").groupBy("id", F.col("teacher").cast("string").alias("item")).agg(F.array_join(F.array_sort(F.collect_set("area")), ",").alias("detail"))
    return bases.select("id", F.lit("base").alias("kind"), "item", "detail").unionAll(teachers.select("id", F.lit("specialist"), "item", "detail"))
