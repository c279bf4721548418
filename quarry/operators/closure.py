"""Fixpoints over prerequisite edges (src, dst, conf): closures, bounds, depths, layers.

Closures of all nodes go by levels in packed rows (carried.py), so that pairs are no rows of a shuffle. The others, and what lies on cycles or behind one, are semi-naive iterations: only what the last
round found or improved is joined to the edges, with a checkpoint per round, so plans stay small and lost executors cost one round. Spark's recursive CTE has no deduplicating UNION and a limit of a million
rows, so it can't express these. Joins are shuffled, also those of small rounds: broadcasts of all rounds pass through the driver.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.lineage import checkpoint, shuffled
from quarry.operators import carried

#: Rounds after which the parts found so far are written as one.
TOGETHER = 50


def _by_levels(edges: DataFrame, kind: carried.Kind, own: DataFrame | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """(node, items, values): what each node takes over from those before it, as carried.carry gives it, of the nodes that are on no cycle and behind none; (node): the others, or None without any.

    edges: (src, dst, conf), each once; own: (node, item), longs. By levels only where all ends are whole numbers and nothing is null; elsewhere the first is None.
    """
    whole = {"tinyint", "smallint", "int", "bigint"}
    if not {edges.schema[c].dataType.simpleString() for c in ("src", "dst")} <= whole or not edges.where("src IS NULL OR dst IS NULL OR conf IS NULL").isEmpty():
        return None, None
    long = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), "conf")
    leads = long.select(F.col("src").alias("dst")).distinct().withColumn("leads", F.lit(True))
    ahead = checkpoint(long.join(shuffled(leads), "dst", "left").select("src", "dst", "conf", "leads"))
    # nodes that lead to none, mostly the greater part, all come last, so that the rounds of depths are without them
    last = ahead.where("leads IS NULL")
    inside = checkpoint(depths(ahead.where("leads"), last.select(F.col("src").alias("node"))))
    levels = inside.unionAll(last.select(F.col("dst").alias("node")).distinct().withColumn("depth", F.lit(carried.LAST)))
    stuck = checkpoint(ahead.select("src").distinct().join(shuffled(inside.select(F.col("node").alias("src"))), "src", "left_anti"))
    if stuck.isEmpty():
        return carried.carry(ahead, levels, kind, own), None
    rest = checkpoint(ahead.join(shuffled(stuck), "src", "left_semi").select(F.col("dst").alias("node")).distinct())
    free = checkpoint(ahead.join(shuffled(rest.withColumnRenamed("node", "dst")), "dst", "left_anti").select("src", "dst", "conf"))
    # of a node all that it leads to may be among the rest
    leads = free.select(F.col("src").alias("node")).distinct().withColumn("leads", F.lit(True))
    levels = levels.join(shuffled(rest), "node", "left_anti").join(shuffled(leads), "node", "left").select("node", F.when(F.col("leads"), F.col("depth")).otherwise(carried.LAST).alias("depth"))
    return carried.carry(free, levels, kind, own), rest


def _flat(packed: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, value): a row for each node and item, without each node's own, in the types of the edges."""
    rows = packed.select("node", "values", F.posexplode("items").alias("at", "item")).where("item <> node")
    return rows.select(F.col("item").cast(edges.schema["src"].dataType).alias("src"), F.col("node").cast(edges.schema["dst"].dataType).alias("dst"), F.get("values", F.col("at")).alias("value"))


def numbered(values: DataFrame) -> DataFrame:
    """(..., item): the distinct rows, each with a number of its own."""
    return checkpoint(values.distinct().withColumn("item", F.monotonically_increasing_id()))


def inherited(edges: DataFrame, own: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, item): of the items that nodes before each node of `wanted` own, those wanted of it, and one of the others at least where there are any; each once.

    edges: (src, dst); own: (node, item), with numbers as items; wanted: (node, item), an item null where a node wants none in particular. Only items go along the edges, not the nodes that own them, and of the sets that
    come of it only what is wanted is a row.
    """
    base = checkpoint(edges.select("src", "dst").distinct())
    own, wants = own.select("node", "item").distinct(), wanted.groupBy("node").agg(F.collect_set("item").alias("wants"))
    above = lambda pairs: pairs.select(F.col("dst").alias("node"), F.col("src").alias("above")).join(shuffled(own.toDF("above", "item")), "above").select("node", "item").distinct().join(shuffled(wants.select("node")), "node", "left_semi")
    packed, rest = _by_levels(base.withColumn("conf", F.lit(1.0)), carried.OWNED, own)
    if packed is None:
        return above(_pairs(base, None))
    some = F.get(F.filter("items", lambda x, i: F.get("values", i) == 1), F.lit(0)).alias("some")
    rows = packed.join(shuffled(wants), "node").select("node", "wants", "values", some, F.posexplode("items").alias("at", "item"))
    rows = rows.where((F.get("values", F.col("at")) == 1) & ((F.col("item") == F.col("some")) | F.array_contains("wants", F.col("item")))).select("node", "item")
    return rows if rest is None else rows.unionAll(above(_pairs(base, None, rest.withColumnRenamed("node", "dst"))))


def _pairs(edges: DataFrame, rounds: int | None, ends: DataFrame | None = None) -> DataFrame:
    """(src, dst, hops): all reachable pairs with their shortest distance, up to `rounds` hops; with ends (dst), only those that end there.

    In rounds, a round's pairs are new unless an earlier round found them; the pairs found so far are shuffled by src and dst to meet them, once a round.
    """
    base = checkpoint(edges.select("src", "dst").distinct())
    if rounds is None and ends is None:
        packed, rest = _by_levels(base.withColumn("conf", F.lit(1.0)), carried.HOPS)
        if packed is not None:
            far = _flat(packed, base).withColumnRenamed("value", "hops")
            return far if rest is None else far.unionAll(_pairs(base, None, rest.withColumnRenamed("node", "dst")))
    first = base if ends is None else base.join(shuffled(ends.select("dst").distinct()), "dst", "left_semi").select("src", "dst")
    # pairs grow at their source, so that those of the ends stay those of the ends
    step = shuffled(base.toDF("far", "src"))
    found = delta = checkpoint(first.withColumn("hops", F.lit(1)))
    for hops in range(2, rounds + 1) if rounds else count(2):
        new = delta.select("src", "dst").join(step, "src").select(F.col("far").alias("src"), "dst").distinct()
        delta = checkpoint(new.join(shuffled(found.select("src", "dst")), ["src", "dst"], "left_anti").withColumn("hops", F.lit(hops)))
        if delta.isEmpty():
            break
        found = found.unionAll(delta)
        if hops % TOGETHER == 0:
            found = checkpoint(found)
    return found


def ancestors(edges: DataFrame, min_confidence: float = 0.0, nodes: DataFrame | None = None) -> DataFrame:
    """(node, ancestor, hops), of all nodes or those of nodes (node) only, in which case nothing else is closed."""
    ends = None if nodes is None else nodes.select(F.col("node").alias("dst"))
    return _pairs(edges.where(F.col("conf") >= min_confidence), None, ends).select(F.col("dst").alias("node"), F.col("src").alias("ancestor"), "hops")


def descendants(edges: DataFrame) -> DataFrame:
    """(node, descendant, hops)."""
    return _pairs(edges, None).select(F.col("src").alias("node"), F.col("dst").alias("descendant"), "hops")


def bounded_chain(edges: DataFrame, hops: int, min_confidence: float = 0.0) -> DataFrame:
    """(node, ancestor, hops): ancestors within a number of hops. One hop is a direct prerequisite."""
    return _pairs(edges.where(F.col("conf") >= min_confidence), hops).select(F.col("dst").alias("node"), F.col("src").alias("ancestor"), "hops")


def bottleneck(edges: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(src, dst, bound): over all paths, the largest of their smallest confidences."""
    best = checkpoint(edges.groupBy("src", "dst").agg(F.max("conf").alias("bound")))
    if max_hops is None:
        packed, rest = _by_levels(best.withColumnRenamed("bound", "conf"), carried.BOUND)
        if packed is not None:
            far = _flat(packed, best).select("src", "dst", F.col("value").cast(best.schema["bound"].dataType).alias("bound"))
            return far if rest is None else far.unionAll(_bounds(best, None, rest.withColumnRenamed("node", "dst")))
    return _bounds(best, max_hops)


def _bounds(base: DataFrame, max_hops: int | None, ends: DataFrame | None = None) -> DataFrame:
    """bottleneck() in rounds, of edges (src, dst, bound), each once; with ends (dst), only the pairs that end there.

    Only pairs that a round improves go into the next. Each round's improvements are a table of their own; a pair's bound is its best among them, so
    they are put together every TOGETHER rounds and at the end only.
    """
    step = shuffled(base.toDF("far", "mid", "conf"))
    best = delta = base if ends is None else checkpoint(base.join(shuffled(ends.distinct()), "dst", "left_semi").select("src", "dst", "bound"))
    for hops in range(2, max_hops + 1) if max_hops else count(2):
        new = (
            delta.select(F.col("src").alias("mid"), "dst", "bound").join(step, "mid")
            .select(F.col("far").alias("src"), "dst", F.least("bound", "conf").alias("bound"), F.lit(True).alias("new"))
        )
        # one shuffle: a round's pairs meet what was found of them
        both = new.unionAll(best.select("src", "dst", "bound", F.lit(False)))
        merged = both.groupBy("src", "dst").agg(F.max(F.when(F.col("new"), F.col("bound"))).alias("bound"), F.max(F.when(~F.col("new"), F.col("bound"))).alias("old"))
        delta = checkpoint(merged.where("bound is not null and (old is null or bound > old)").select("src", "dst", "bound"))
        if delta.isEmpty():
            break
        best = best.unionAll(delta)
        if hops % TOGETHER == 0:
            best = checkpoint(best.groupBy("src", "dst").agg(F.max("bound").alias("bound")))
    return best.groupBy("src", "dst").agg(F.max("bound").alias("bound"))


def depths(edges: DataFrame, nodes: DataFrame | None = None, graph: str | None = None) -> DataFrame:
    """(node, depth): longest path from a node without prerequisites, which has depth 0. edges: (src, dst), best each once, as those that come twice go through all rounds twice; nodes: (node), to
    include isolated ones.

    graph: a column of edges and nodes that tells graphs apart, in which the same node may be; then (graph, depth): the longest path in each.

    Round n finds the nodes at which a path of n edges ends. They are fewer in each round, and only the edges that go on from them are kept. Where these get no fewer, their ends are a cycle's nodes and
    what depends on them, which have no depth and are left out.
    """
    apart = [] if graph is None else [graph]
    at = lambda rows, end, depth: rows.select(*apart, F.col(end).alias("node"), F.lit(depth).alias("depth"))
    left = checkpoint(edges.select(*apart, "src", "dst"))
    found = at(left, "src", 0) if nodes is None else at(left, "src", 0).unionAll(at(nodes, "node", 0))
    blocked, n = None, left.count()
    for depth in count(1):
        if n == 0:
            break
        ends = left.select(*apart, F.col("dst").alias("src")).distinct().withColumn("goes_on", F.lit(True))
        met = checkpoint(left.join(shuffled(ends), [*apart, "src"], "left").select(*apart, "src", "dst", "goes_on"))
        # each edge gives a depth once: in the last round that has it
        found = found.unionAll(at(met.where("goes_on IS NULL"), "dst", depth))
        left, before = met.where("goes_on").drop("goes_on"), n
        n = left.count()
        if n == before:
            blocked = left.select(*apart, F.col("dst").alias("node")).distinct()
            break
        if depth % TOGETHER == 0:
            found = checkpoint(found.groupBy(*apart, "node").agg(F.max("depth").alias("depth")))
    deepest = lambda rows, *by: rows.groupBy(*by).agg(F.max("depth").alias("depth"))
    if blocked is None:
        return deepest(found, *(apart or ["node"]))
    free = deepest(found, *apart, "node").join(shuffled(blocked), [*apart, "node"], "left_anti")
    return deepest(free, *apart) if apart else free.select("node", "depth")


def needed(edges: DataFrame, targets: DataFrame, completed: DataFrame) -> DataFrame:
    """(target, course): each target and what it needs at any distance, without what is completed. targets: (target); completed: (course)."""
    chain = ancestors(edges, nodes=targets.withColumnRenamed("target", "node")).select(F.col("node").alias("target"), F.col("ancestor").alias("course"))
    return chain.unionAll(targets.select("target", F.col("target").alias("course"))).join(shuffled(completed), "course", "left_anti").distinct()


def plan_layers(edges: DataFrame, targets: DataFrame, completed: DataFrame, need: DataFrame | None = None) -> DataFrame:
    """(target, layer, course): what is still to be taken before a target, in the order of layers; the target is in the last.

    targets: (target); completed: (course); need: what needed() gave, if it was asked before. A layer holds what only needs completed courses or earlier layers, so
    courses of a cycle and those behind one have none: cycles.plan_gaps reports them.
    """
    need = checkpoint(needed(edges, targets, completed)) if need is None else need
    inner = need.join(shuffled(edges.select("src", F.col("dst").alias("course")).distinct()), "course").join(
        shuffled(need.select("target", F.col("course").alias("src"))), ["target", "src"], "left_semi"
    )
    # nodes of different targets are kept apart by pairing them with the target
    name = F.struct("target", "course")
    sub = inner.select(F.struct("target", F.col("src").alias("course")).alias("src"), name.alias("dst"))
    layered = depths(sub, need.select(name.alias("node")))
    return layered.select("node.target", (F.col("depth") + 1).alias("layer"), "node.course")


def path_confidence(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """(target, course, confidence): the least confidence of a planned course's own prerequisite edges, where it is below 1."""
    least = edges.groupBy(F.col("dst").alias("course")).agg(F.min("conf").alias("confidence"))
    return layers.join(shuffled(least), "course").where("confidence < 1").select("target", "course", "confidence")


def failure_report(edges: DataFrame, parity: DataFrame) -> DataFrame:
    """failure_impact() with the terms in which each course is offered. parity: (course, parity), as from audit.offer_parity; null where it has none."""
    return failure_impact(edges).join(shuffled(parity.select(F.col("course").alias("node"), "parity")), "node", "left")


def failure_impact(edges: DataFrame) -> DataFrame:
    """(node, direct, transitive, depth, critical): what failing a course blocks; depth is the longest of the shortest distances."""
    reach = descendants(edges)
    return reach.groupBy("node").agg(
        F.count_if(F.col("hops") == 1).alias("direct"), F.count("*").alias("transitive"), F.max("hops").alias("depth"), (F.count_if(F.col("hops") == 1) >= 2).alias("critical")
    )


def highlights(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, node, part, rule): what the graph says of a question by itself (base) and what rules add (inferred), each node once.

    asked: (id, intent, course). prerequisite_chain: the course and what it directly needs; by 'prereq_transitivity' all that these need, by 'co_prerequisite' what is needed together with the
    course. dependents: the course and what directly needs it. trajectory_planning: the course and what it directly needs, and by 'minimal_path' all that these need. Other intents show nothing.
    """
    of = lambda *intents: asked.where(F.col("intent").isin(*intents)).select("id", "intent", "course").distinct()
    chains = of("prerequisite_chain", "trajectory_planning")
    reach = ancestors(edges, nodes=chains.select(F.col("course").alias("node")).distinct()).withColumnRenamed("node", "course")
    rule = F.when(F.col("intent") == "trajectory_planning", "minimal_path").otherwise("prereq_transitivity")
    near = F.col("hops") == 1
    above = chains.join(shuffled(reach), "course").select("id", F.col("ancestor").alias("node"), F.when(near, 0).otherwise(1).alias("rank"), F.when(~near, rule).alias("rule"))
    own = of("prerequisite_chain", "trajectory_planning", "dependents").select("id", F.col("course").alias("node"), F.lit(0).alias("rank"), F.lit(None).cast("string").alias("rule"))
    pairs = edges.select("src", "dst").distinct()
    below = of("dependents").join(shuffled(pairs.withColumnRenamed("src", "course")), "course").select("id", F.col("dst").alias("node"), F.lit(0), F.lit(None).cast("string"))
    with_it = of("prerequisite_chain").join(shuffled(pairs.withColumnRenamed("src", "course")), "course").join(shuffled(pairs.withColumnRenamed("src", "other")), "dst").where("other <> course")
    together = with_it.select("id", F.col("other").alias("node"), F.lit(2), F.lit("co_prerequisite")).distinct()
    best = own.unionAll(above).unionAll(below).unionAll(together).groupBy("id", "node").agg(F.min(F.struct("rank", "rule")).alias("b"))
    return best.select("id", "node", F.when(F.col("b.rank") == 0, "base").otherwise("inferred").alias("part"), F.coalesce("b.rule", F.lit("")).alias("rule"))
