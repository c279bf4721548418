"""Operators on a property graph: nodes (node_id, kind, name) and edges (src, dst, relation, conf), or plain (src, dst, conf)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators.names import containing


def count_by_kind(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count("*").alias("nodes"))


def count_by_relation(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


def neighbours(edges: DataFrame, relation: str | None = None, reverse: bool = False, min_confidence: float = 0.0) -> DataFrame:
    """(node, neighbour, conf): one hop along a relation, or against it."""
    some = edges.where(F.col("conf") >= min_confidence)
    if relation is not None:
        some = some.where(F.col("relation") == relation)
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return some.select(F.col(a).alias("node"), F.col(b).alias("neighbour"), "conf")


def critical(edges: DataFrame, threshold: int = 2) -> DataFrame:
    """Nodes that at least `threshold` others directly depend on."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.countDistinct("dst").alias("dependents")).where(F.col("dependents") >= threshold)


def co_prerequisites(edges: DataFrame) -> DataFrame:
    """(node, other, shared): pairs of distinct sources with a common target, and how many they share."""
    one = edges.select("src", "dst").distinct()
    two = one.toDF("other", "dst")
    return one.join(two, "dst").where("src <> other").groupBy(F.col("src").alias("node"), "other").agg(F.count("*").alias("shared"))


def unlocked(edges: DataFrame, completed: DataFrame) -> DataFrame:
    """(student, course): courses with prerequisites, all of which the student has completed, and that are not completed yet.

    completed: (student, course). Relational division by counting, so only courses next to completed ones are touched.
    """
    need = edges.groupBy(F.col("dst").alias("next")).agg(F.countDistinct("src").alias("needed"))
    pairs = edges.select("src", "dst").distinct()
    have = completed.join(pairs, F.col("course") == F.col("src")).groupBy("student", F.col("dst").alias("next")).agg(F.count("*").alias("done"))
    ready = have.join(need, "next").where("done = needed").select("student", F.col("next").alias("course"))
    return ready.join(completed, ["student", "course"], "left_anti")


def lint(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem, subject, detail): names that several nodes of a kind share after normalising, nodes without edges, edges to nowhere, two-way edges."""
    key = text.graph_key("name")
    same = nodes.groupBy("kind", key.alias("key")).agg(F.count("*").alias("n")).where("n > 1").selectExpr("'duplicate_name' AS problem", "concat(kind, '|', key) AS subject", "n AS detail")
    ends = edges.select(F.col("src").alias("node_id")).unionAll(edges.select("dst")).distinct()
    alone = nodes.join(ends, "node_id", "left_anti").selectExpr("'no_edges'", "node_id", "0L")
    nowhere = ends.join(nodes, "node_id", "left_anti").selectExpr("'unknown_node'", "node_id", "0L")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relation")
    both = edges.select("src", "dst", "relation").distinct().join(back.distinct(), ["src", "dst", "relation"], "left_semi").where("src <= dst").selectExpr("'two_way'", "concat(src, '|', dst)", "0L")
    return same.unionAll(alone).unionAll(nowhere).unionAll(both)


def lookup_table(nodes: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """(key, node_id): the first kind of key that has it wins, then the smallest node id."""
    all_keys = None
    for priority, c in enumerate(keys.values()):
        part = nodes.select(c.alias("key"), F.lit(priority).alias("priority"), "node_id").where("key is not null and key <> ''")
        all_keys = part if all_keys is None else all_keys.unionAll(part)
    return all_keys.groupBy("key").agg(F.min(F.struct("priority", "node_id")).alias("m")).select("key", F.col("m.node_id").alias("node_id"))


def resolve(terms: DataFrame, nodes: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """(term, node_id, how): by an exact key, else by the first node (smallest id) whose name contains the term; an empty term has none."""
    normal = terms.select("term", text.graph_key("term").alias("key"))
    exact = normal.join(lookup_table(nodes, keys), "key", "left")
    found = exact.where("node_id is not null").select("term", "node_id", F.lit("key").alias("how"))
    names = nodes.select(F.col("node_id").alias("other"), text.graph_key("name").alias("name_key"))
    rest = exact.where("node_id is null").select("term", "key").distinct().where("key <> ''")
    held = containing(rest, "key", names, "name_key").groupBy("term").agg(F.min("other").alias("node_id"))
    loose = rest.select("term").join(held, "term", "left").select("term", "node_id", F.when(F.col("node_id").isNotNull(), "part").otherwise("none").alias("how"))
    return found.unionAll(loose).unionAll(exact.where("node_id is null and key = ''").select("term", "node_id", F.lit("none")))


def mentions(texts: DataFrame, names: DataFrame, longest: int = 3) -> DataFrame:
    """(id, name): the longest names that stand in each text as whole words, at most `longest` ordered by length then name.

    texts: (id, text); names: (name). Texts are cut into word n-grams of the lengths that names have, so names are found by an equi-join.
    """
    keyed = names.select(text.graph_key("name").alias("key"), "name").where("key <> ''").groupBy("key").agg(F.min("name").alias("name"))
    keyed = keyed.withColumn("n_words", F.size(F.split("key", " ")))
    words = texts.select("id", F.split(text.graph_key("text"), " ").alias("w"))
    lengths = keyed.agg(F.collect_set("n_words").alias("lengths"))  # one row; as many as the longest name has words at most
    grams = words.crossJoin(F.broadcast(lengths)).select("id", "w", F.explode(F.expr("filter(lengths, n -> n <= size(w))")).alias("n_words")).select(
        "id", F.explode(F.expr("array_distinct(transform(sequence(1, size(w) - n_words + 1), i -> array_join(slice(w, i, n_words), ' ')))")).alias("key")
    )
    found = grams.join(keyed, "key").select("id", "name", F.length("key").alias("size"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("size"), "name"))
    return found.withColumn("rank", rank).where(F.col("rank") <= longest).select("id", "name", "rank")


def add_relations(nodes: DataFrame, edges: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Take in extracted (src, dst, relation, conf): missing nodes are created, edges that the graph has already are not repeated."""
    ends = found.select(F.col("src").alias("node_id")).unionAll(found.select("dst")).distinct()
    new = ends.join(nodes, "node_id", "left_anti").select("node_id", F.lower(F.substring_index("node_id", ":", 1)).alias("kind"), F.expr("substring(node_id, instr(node_id, ':') + 1)").alias("name"))
    best = found.groupBy("src", "dst", "relation").agg(F.max("conf").alias("conf"))
    return nodes.unionByName(new), edges.unionByName(best.join(edges, ["src", "dst", "relation"], "left_anti").select("src", "dst", "relation", "conf"))


def extraction_stats(edges: DataFrame) -> DataFrame:
    """(measure, item, n, mean_confidence): by relation, and by the kinds at either end."""
    relation = edges.groupBy(F.col("relation").alias("item")).agg(F.count("*").alias("n"), F.round(F.avg("conf"), 6).alias("mean_confidence"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"), "conf").groupBy(F.substring_index("node", ":", 1).alias("item"))
    kind = ends.agg(F.count("*").alias("n"), F.round(F.avg("conf"), 6).alias("mean_confidence"))
    return relation.select(F.lit("relation").alias("measure"), "*").unionAll(kind.select(F.lit("endpoint"), "*"))


def valid_relations(edges: DataFrame, allowed: DataFrame, fallback: str = "RELATED_TO") -> DataFrame:
    """Edges with the relation that their kinds allow, else `fallback`; clamped confidence. allowed: (src_kind, dst_kind, relation), a fixed small table."""
    kind = edges.withColumns({"src_kind": F.substring_index("src", ":", 1), "dst_kind": F.substring_index("dst", ":", 1)})
    ok = allowed.withColumn("ok", F.lit(True))
    joined = kind.join(F.broadcast(ok), ["src_kind", "dst_kind", "relation"], "left")
    return joined.select("src", "dst", F.when(F.col("ok"), F.col("relation")).otherwise(fallback).alias("relation"), F.greatest(F.lit(0.0), F.least("conf", F.lit(1.0))).alias("conf"))


def export(nodes: DataFrame, edges: DataFrame, label: int = 50) -> DataFrame:
    """(element, payload): JSON of nodes with shortened labels, and of edges."""
    shown = text.truncate_words("name", label)
    n = nodes.select(F.lit("node").alias("element"), F.to_json(F.struct(F.col("node_id").alias("id"), "kind", shown.alias("label"))).alias("payload"))
    e = edges.select(F.lit("edge").alias("element"), F.to_json(F.struct("src", "dst", "relation")).alias("payload"))
    return n.unionAll(e)
