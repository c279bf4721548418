"""Connected components of a link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _follow(nodes: DataFrame) -> DataFrame | None:
    """The nodes with the root of their root; None if all roots are their own.

    Only roots that hang below another are looked up, and the many nodes of one root are dealt to several tasks.
    """
    up = nodes.select(F.col("node").alias("of"), F.col("root").alias("above")).where("of <> above")
    used = nodes.select(F.col("root").alias("of")).distinct()
    moved = common.checkpoint(up.join(used, "of"))
    if moved.isEmpty():
        return None
    joined = common.join_lookup(nodes, moved, nodes["root"] == moved["of"], F.xxhash64(nodes["node"]))
    return common.checkpoint(joined.select("node", F.coalesce("above", "root").alias("root")))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b), root the smallest node of its component.

    Every round takes the smallest root among a node's neighbours, then the root of that root, so that
    the rounds grow as the logarithm of a component's diameter. Links between nodes of the same root
    are dropped from later rounds; each round's tables are checkpointed. A node of many links, or a root of many nodes, is dealt to several tasks.
    """
    nodes = common.checkpoint(
        links.select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
        .unionAll(links.select(F.col("b").alias("node"), F.least("a", "b").alias("root")))
        .groupBy("node")
        .agg(F.min("root").alias("root"))
    )
    left = links.select("a", "b")
    while True:
        nodes = _follow(nodes) or nodes
        ends, other = nodes.toDF("end_a", "ra"), nodes.toDF("end_b", "rb")
        one = common.join_lookup(left, ends, left["a"] == ends["end_a"], F.xxhash64(left["b"]), "inner")
        two = common.join_lookup(one, other, one["b"] == other["end_b"], F.xxhash64(one["a"]), "inner")
        left = common.checkpoint(two.where("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct())
        if left.isEmpty():
            break
        # roots hang below the smallest root that they have a link to
        hung = common.checkpoint(left.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("under")))
        joined = common.join_lookup(nodes, hung, nodes["root"] == hung["of"], F.xxhash64(nodes["node"]))
        nodes = common.checkpoint(joined.select("node", F.coalesce("under", "root").alias("root")))
    while (deeper := _follow(nodes)) is not None:
        nodes = deeper
    return nodes
