"""What the nodes of an acyclic graph take over from all nodes before them, level by level, in packed rows.

A node's level is the longest path to it, so that all it takes over is whole when its turn comes: it is made once, goes once along each edge, and what was found before is never shuffled again. What a node
holds is packed into rows of bounded size. Only nodes that lead to others are stored; those that lead to none, mostly the greater part, are made as the result is read, and the result itself is stored nowhere.
Large sets are parted into blocks of items, so that no task holds a whole one.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.lineage import Rounds, shuffled

#: Items of a packed row, edges that leave a node in one row, items of a node that a task holds at once, and items that a task is given, about.
ROW, EDGES, HELD, TASK = 1024, 1024, 1 << 21, 1 << 21
#: The level of nodes that lead to none.
LAST = (1 << 31) - 1


@dataclasses.dataclass(frozen=True)
class Kind:
    """value: its type; start: an own item's value; after: the value at the end of an edge of a confidence; better: which of two values of an item stays."""

    value: str
    start: float
    after: Callable[[np.ndarray, np.ndarray], np.ndarray]
    better: np.ufunc


#: The least number of edges; the largest of the smallest confidences; 1 for what is taken over, not only a node's own.
HOPS = Kind("int", 0, lambda v, conf: v + v.dtype.type(1), np.minimum)
BOUND = Kind("double", float("inf"), lambda v, conf: np.fmin(v, conf), np.maximum)
OWNED = Kind("tinyint", 0, lambda v, conf: np.ones_like(v), np.maximum)

_TARGETS = "array<struct<t: int, dst: bigint, conf: double>>"


@dataclasses.dataclass
class _Groups:
    """Nodes (and blocks) with their items, in order; group: of each item; edges: rows (first, targets) of the groups in `of`."""

    node: np.ndarray
    block: np.ndarray
    group: np.ndarray
    items: np.ndarray
    values: np.ndarray
    of: np.ndarray
    edges: pa.Table

    def part(self, low: int, high: int) -> _Groups:
        inside, kept = (self.group >= low) & (self.group < high), (self.of >= low) & (self.of < high)
        return _Groups(self.node[low:high], self.block[low:high], self.group[inside] - low, self.items[inside], self.values[inside], self.of[kept] - low, self.edges.filter(pa.array(kept)))


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    at = lists.offsets.to_numpy()
    return np.diff(at), lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]


def _grouped(batch: pa.RecordBatch, kind: Kind, before: _Groups | None) -> _Groups:
    """The groups of a batch, which is sorted by node and block, each item once; before: the group that the batch may go on with."""
    node, block, conf, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "block", "conf", "own"))
    counts, items = _flat(batch.column("items"))
    values = _flat(batch.column("values"))[1]
    values = np.where(np.repeat(own, counts), values, kind.after(values, np.repeat(conf, counts)))
    new = np.concatenate([[True], (node[1:] != node[:-1]) | (block[1:] != block[:-1])])
    at, nodes, blocks, edges = np.cumsum(new) - 1, node[new], block[new], pa.Table.from_batches([batch.select(["first", "targets"])])
    edges, of, group = edges.filter(pa.array(own)), at[own], np.repeat(at, counts)
    if before is not None:
        apart = int((nodes[0], blocks[0]) != (before.node[0], before.block[0]))
        nodes, blocks = np.concatenate([before.node, nodes[1 - apart :]]), np.concatenate([before.block, blocks[1 - apart :]])
        group, of = np.concatenate([before.group, group + apart]), np.concatenate([before.of, of + apart])
        items, values, edges = np.concatenate([before.items, items]), np.concatenate([before.values, values]), pa.concat_tables([before.edges, edges])
    if len(items):
        low = items.min()
        span = int(items.max()) - int(low) + 1
        # one number for group and item, where it fits
        order = np.argsort(group * span + (items - low)) if span * len(nodes) < 1 << 62 else np.lexsort((items, group))
        group, items, values = group[order], items[order], values[order]
        starts = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (items[1:] != items[:-1])]))
        group, items, values = group[starts], items[starts], kind.better.reduceat(values, starts).astype(values.dtype)
    return _Groups(nodes, blocks, group, items, values, of, edges)


def _pieces(found: _Groups) -> tuple[np.ndarray, np.ndarray, pa.ListArray, pa.ListArray]:
    """For each group how many pieces of at most ROW items it has; for each piece its group; the pieces' items and values."""
    counts = np.bincount(found.group, minlength=len(found.node))
    pieces = -(-counts // ROW)
    of = np.repeat(np.arange(len(counts)), pieces)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = np.concatenate([np.repeat(np.cumsum(counts) - counts, pieces) + nth * ROW, [len(found.items)]]).astype(np.int32)
    return pieces, of, pa.ListArray.from_arrays(at, pa.array(found.items)), pa.ListArray.from_arrays(at, pa.array(found.values))


def _merge(kind: Kind, stored: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows sorted by node and block those of a node as one, in pieces; stored: with its edges, as often as they have rows."""

    def rows(found: _Groups) -> Iterator[pa.RecordBatch]:
        pieces, of, items, values = _pieces(found)
        if not stored:
            columns = [pa.array(found.node[of]), items, values]
            if len(of):
                yield pa.RecordBatch.from_arrays(columns, ["node", "items", "values"])
            return
        n = pieces[found.of]
        edge = np.repeat(np.arange(len(n)), n)
        piece = (np.cumsum(pieces) - pieces)[found.of][edge] + np.arange(len(edge)) - np.repeat(np.cumsum(n) - n, n)
        for low in range(0, len(edge), 4096):
            e, p = edge[low : low + 4096], piece[low : low + 4096]
            own = found.edges.take(pa.array(e)).combine_chunks()
            out, lists = [own.column(c).combine_chunks() for c in ("first", "targets")], items.take(pa.array(p))
            size = pa.array(np.diff(lists.offsets.to_numpy()).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(found.node[of[p]]), *out, lists, values.take(pa.array(p)), size], ["node", "first", "targets", "items", "values", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if batch.num_rows:
                found = _grouped(batch, kind, last)
                n = len(found.node) - 1
                yield from rows(found.part(0, n)) if n else ()
                last = found.part(n, n + 1)
        if last is not None:
            yield from rows(last)

    return run


def _parted(blocks: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each row as one for each block of items that it has some of; rows with edges as one for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, items = _flat(batch.column("items"))
            values, own = _flat(batch.column("values"))[1], batch.column("own").to_numpy(zero_copy_only=False)
            block = ((items.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % blocks
            key = np.repeat(np.arange(len(counts)), counts) * blocks + block
            order = np.argsort(key, kind="stable")
            every = (np.flatnonzero(own)[:, None] * blocks + np.arange(blocks)).ravel()
            keys = np.union1d(key, every)
            at = pa.array(np.concatenate([np.searchsorted(key[order], keys), [len(key)]]).astype(np.int32))
            parts = {"block": pa.array((keys % blocks).astype(np.int32)), "items": pa.ListArray.from_arrays(at, pa.array(items[order])), "values": pa.ListArray.from_arrays(at, pa.array(values[order]))}
            row = pa.array(keys // blocks)
            # a row of many edges is copied once a block, some rows at a time
            for low in range(0, len(keys), 4096):
                some = batch.take(row[low : low + 4096])
                yield pa.RecordBatch.from_arrays([parts[c][low : low + 4096] if c in parts else some.column(c) for c in batch.schema.names], names=batch.schema.names)

    return run


def carry(edges: DataFrame, levels: DataFrame, kind: Kind, own: DataFrame | None = None) -> DataFrame:
    """(node, items, values): what each node takes over from the nodes before it, and for those that lead to others, what it owns too; in one row or more, no item twice.

    edges: (src, dst, conf), each once; levels: (node, depth), of all their ends: LAST for those that lead to none, for the others the longest path to each; own: (node, item), by default each node owns itself.
    All ends and items are longs, without nulls. Rows are stored in the shared folder until the session ends, as checkpoints are.
    """
    spark = edges.sparkSession
    rounds = Rounds(spark)
    levels = rounds.keep("levels", levels.select("node", "depth"))
    inner = rounds.keep("inner", edges.select("src", "dst", "conf"))
    target = inner.join(shuffled(levels.select(F.col("node").alias("dst"), F.col("depth").alias("t"))), "dst").select(F.col("src").alias("node"), F.struct("t", "dst", F.col("conf").cast("double").alias("conf")).alias("x"))
    nth = F.row_number().over(Window.partitionBy("node").orderBy("x.dst")) - 1
    out = target.withColumn("first", F.floor(nth / EDGES) == 0).withColumn("chunk", F.floor(nth / EDGES)).groupBy("node", "chunk", "first").agg(F.collect_list("x").alias("targets"))
    out = out.select("node", "first", "targets").join(shuffled(levels), "node")
    start = F.lit(kind.start).cast(kind.value)
    if own is None:
        out = out.withColumn("items", F.when(F.col("first"), F.array("node")).otherwise(F.array().cast("array<bigint>")))
    else:
        mine = own.select("node", "item").distinct().groupBy("node").agg(F.collect_list("item").alias("mine"), F.lit(True).alias("first"))
        out = out.join(shuffled(mine), ["node", "first"], "left").withColumn("items", F.coalesce("mine", F.array().cast("array<bigint>")))
    out = out.select("node", "depth", "first", "targets", "items", F.transform("items", lambda x: start).alias("values"))
    ways = rounds.keep("ways", out.repartitionByRange("depth", "node").sortWithinPartitions("depth"))
    nodes, most = levels.count(), inner.groupBy("dst").count().agg(F.max("count")).first()[0] or 0
    to = ways.select("depth", F.explode("targets.t").alias("t")).groupBy("depth")
    later = {r["depth"]: (r["t"] or -1, r["last"]) for r in to.agg(F.max(F.when(F.col("t") < LAST, F.col("t"))).alias("t"), F.bool_or(F.col("t") == LAST).alias("last")).collect()}
    fields = f"node bigint, block int, conf double, own boolean, first boolean, targets {_TARGETS}, items array<bigint>, values array<{kind.value}>"
    stores: dict[int, tuple[DataFrame, int, int]] = {}

    def sent(t: int) -> tuple[DataFrame | None, int]:
        """What goes to the nodes of a level, and the most items that these may be."""
        some = [stores[d] for d, (far, last) in later.items() if d in stores and (last if t == LAST else far >= t)]
        rows = None
        for store, _, _ in some:
            each = store.select(F.explode(F.filter("targets", lambda x: x["t"] == t)).alias("x"), "items", "values", "n")
            rows = each if rows is None else rows.unionAll(each)
        return rows, sum(n for _, _, n in some)

    def whole(t: int, stored: bool) -> DataFrame:
        rows, n = sent(t)
        blocks = 1
        if max((m for _, m, _ in stores.values()), default=0) * most > HELD:
            blocks = -(-(rows.groupBy("x.dst").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0) // HELD) or 1
        empty = [F.lit(None).cast(c).alias(name) for c, name in (("boolean", "first"), (_TARGETS, "targets"))]
        parts = [] if rows is None else [rows.select("x.dst", F.lit(0), "x.conf", F.lit(False), *empty, "items", "values")]
        if stored:
            parts.append(ways.where(F.col("depth") == t).select("node", F.lit(0), F.lit(None).cast("double"), F.lit(True), "first", "targets", "items", "values"))
        all_ = parts[0] if len(parts) == 1 else parts[1].unionAll(parts[0])
        all_ = all_.toDF("node", "block", "conf", "own", "first", "targets", "items", "values")
        if blocks > 1:
            all_ = all_.mapInArrow(_parted(blocks), fields)
        default = int(spark.conf.get("spark.sql.shuffle.partitions"))
        tasks = max(default, -(-n // TASK))
        # nodes of near numbers go to one task, as they may take over the same, but no task gets many of them
        by = F.expr(f"node div {max(1, nodes // (16 * tasks))}"), F.col("block")
        dealt = all_.repartition(tasks, *by) if tasks > default else all_.repartition(*by)
        made = "node bigint, first boolean, targets " + _TARGETS + ", " if stored else "node bigint, "
        made += f"items array<bigint>, values array<{kind.value}>" + (", n int" if stored else "")
        return dealt.sortWithinPartitions("node", "block").mapInArrow(_merge(kind, stored), made)

    for t in sorted(later):
        store = rounds.keep(f"level{t}", whole(t, True))
        held, total = store.agg(F.max("n"), F.sum(F.col("n").cast("long") * F.size("targets"))).first()
        # a node of several rows has a full one, or came in blocks, as then did nodes of the levels before
        if (held or 0) >= ROW or max((m for _, m, _ in stores.values()), default=0) >= ROW:
            held = store.where("first").groupBy("node").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
        stores[t] = (store, held or 0, total or 0)
    found = whole(LAST, False) if stores else spark.createDataFrame([], f"node bigint, items array<bigint>, values array<{kind.value}>")
    for store, _, _ in stores.values():
        found = found.unionAll(store.where("first").select("node", "items", "values"))
    rounds.leave("levels", "inner", "ways")
    return found
