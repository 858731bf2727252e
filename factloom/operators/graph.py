"""Graphs as edge tables: closures, components, strongly connected components, paths, hierarchies.

Iterations submit one job a round. Each round's table is written to the folder that spark.checkpoint.dir names, which driver
and executors share, so a lost executor never costs the work of earlier rounds.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables of rounds: the session's own checkpoint folder, else the one that spark.checkpoint.dir names.

    Only a local session without either (tests, a laptop) takes a temporary folder.
    """
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "factloom-rounds")


def written(spark: SparkSession, schema: StructType, *paths: str) -> DataFrame:
    """Files of rounds as a table. Its joins merge: such tables pack to a hundredth of their size in memory, and by the size on
    disk a join would broadcast millions of rows through the driver."""
    return spark.read.schema(schema).parquet(*paths).hint("merge")


def settled(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again: without its lineage, and computed once.

    A table, unlike a checkpoint, also drops what the planner knows of the rows, which grows from round to round.
    """
    spark: SparkSession = df.sparkSession
    path = f"{shared_folder(spark)}/rounds-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return written(spark, df.schema, path)


class Rounds:
    """A table that grows by rounds. A round writes its new rows alone; what is known are the files of all rounds together."""

    def __init__(self, first: DataFrame):
        self.spark: SparkSession = first.sparkSession
        self.folder = f"{shared_folder(self.spark)}/rounds-{self.spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
        self.schema, self.paths = first.schema, []
        self.add(first)

    def add(self, rows: DataFrame) -> None:
        path = f"{self.folder}/{len(self.paths)}"
        rows.select(*self.schema.names).write.parquet(path)
        self.paths.append(path)
        self.new = self._read(path)

    def _read(self, *paths: str) -> DataFrame:
        return written(self.spark, self.schema, *paths)

    @property
    def known(self) -> DataFrame:
        return self._read(*self.paths)


def spread(group: np.ndarray, starts: np.ndarray, at: np.ndarray, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, node): what starts (group, node) reach over steps (at: their group, src, dst), themselves included."""
    values, rank = np.unique(np.concatenate([starts, src, dst]), return_inverse=True)
    ids, node = np.unique(np.concatenate([group, at, at]) * len(values) + rank, return_inverse=True)
    first, tail, head = node[: len(starts)], node[len(starts) : len(starts) + len(src)], node[len(starts) + len(src) :]
    head = head[np.argsort(tail, kind="stable")]
    begin = np.concatenate([[0], np.cumsum(np.bincount(tail, minlength=len(ids)))])
    seen, now = np.zeros(len(ids), bool), np.unique(first)
    while len(now):
        seen[now] = True
        n = begin[now + 1] - begin[now]
        to = head[np.arange(n.sum()) + np.repeat(begin[now] - np.cumsum(n) + n, n)]
        now = np.unique(to[~seen[to]])
    return ids[seen] // len(values), values[ids[seen] % len(values)]


def steps_by(steps: DataFrame, by: str) -> DataFrame:
    """by, steps: the steps (by, node, next) of each group together, settled for several calls of `reached`."""
    return settled(steps.groupBy(by).agg(F.collect_list(F.struct(F.col("node").cast("long").alias("node"), F.col("next").cast("long").alias("next"))).alias("steps")))


def reached(starts: DataFrame, ways: DataFrame, by: str, rows: int = 256) -> DataFrame:
    """by, node: what the starts (by, node) of each group reach over its ways (steps_by), themselves included.

    For groups that are as small as a method: one is a row, and `rows` of them are walked together, so no pair is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, rows):
                b = whole.slice(k, rows)
                begin, steps = b.column(1), b.column(2)
                src, dst = steps.flatten().flatten()
                number = lambda x: x.to_numpy(zero_copy_only=False).astype(np.int64)
                at, node = spread(number(pc.list_parent_indices(begin)), number(begin.flatten()), number(pc.list_parent_indices(steps)), number(src), number(dst))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(node)], names=[by, "node"])

    of = starts.groupBy(by).agg(F.collect_set(F.col("node").cast("long")).alias("begin")).join(ways, by, "left").select(by, "begin", "steps")
    found = of.mapInArrow(run, StructType([starts.schema[by], StructField("node", LongType())]))
    return found.select(by, F.col("node").cast(starts.schema["node"].dataType).alias("node"))


def closure(edges: DataFrame, seed: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """src, dst, depth: every pair joined by a path, with the length of the shortest; paths from `seed` (src) alone if given.

    Semi-naive: only pairs found in the last round meet the edges, and pairs known already leave. A node is its own
    descendant only on a cycle.
    """
    e = settled(edges.select("src", "dst").distinct())
    first = e if seed is None else e.join(seed.select("src").distinct(), "src", "left_semi")
    pairs = Rounds(first.withColumn("depth", F.lit(1)))
    step = e.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    depth = 1
    while (most is None or depth < most) and not pairs.new.isEmpty():
        depth += 1
        new = pairs.new.join(step, "dst").select("src", F.col("next").alias("dst")).distinct()
        pairs.add(new.join(pairs.known.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)))
    return pairs.known


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, component: the least node reachable over edges (a, b) taken both ways; lone nodes of `nodes` are their own.

    Every node points to its least neighbour, pointers are followed, and the edges are carried along until none is left.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    graph = settled(both.filter("a <> b").distinct())
    label = settled(both.select(F.col("a").alias("node")).unionByName(nodes.select("node") if nodes is not None else both.select(F.col("a").alias("node"))).distinct().withColumn("component", F.col("node")))
    while not graph.isEmpty():
        least = graph.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("b")).select("n", F.least("n", "b").alias("to"))
        hop = least.select(F.col("n").alias("mid"), F.col("to").alias("far"))
        point = settled(least.join(hop, F.col("to") == F.col("mid")).select("n", F.col("far").alias("to")))
        label = settled(label.join(point, F.col("component") == F.col("n"), "left").select("node", F.coalesce("to", "component").alias("component")))
        p, q = point.select(F.col("n").alias("n1"), F.col("to").alias("t1")), point.select(F.col("n").alias("n2"), F.col("to").alias("t2"))
        graph = settled(graph.join(p, F.col("a") == F.col("n1")).join(q, F.col("b") == F.col("n2")).filter("t1 <> t2").select(F.col("t1").alias("a"), F.col("t2").alias("b")).distinct())
    return label


def trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    """The edges that are left when nodes without a way in or out are taken away until none is, and their number."""
    n, left = -1, edges.count()
    while left and left != n:
        heads, tails = edges.select(F.col("src").alias("dst")).distinct(), edges.select(F.col("dst").alias("src")).distinct()
        edges = settled(edges.join(tails, "src", "left_semi").join(heads, "dst", "left_semi").select("src", "dst"))
        n, left = left, edges.count()
    return edges, left


def least_sources(edges: DataFrame) -> DataFrame:
    """node, colour: the least node from which a node is reached, itself included. Only colours that fell are passed on."""
    first = edges.groupBy("dst").agg(F.min("src").alias("s")).select(F.col("dst").alias("node"), F.least("s", "dst").alias("colour"))
    falls = Rounds(first.union(edges.select("src", "src")).groupBy("node").agg(F.min("colour").alias("colour")))
    lowest = lambda: falls.known.groupBy("node").agg(F.min("colour").alias("colour"))
    while not falls.new.isEmpty():
        offer = falls.new.join(edges, F.col("node") == F.col("src")).groupBy("dst").agg(F.min("colour").alias("offer"))
        falls.add(lowest().join(offer, F.col("node") == F.col("dst")).filter("offer < colour").select("node", F.col("offer").alias("colour")))
    return lowest()


def strong_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, component: the least node that it reaches and is reached by.

    Every node takes the least node that reaches it as its colour; what reaches that one back within the colour is its component.
    Edges between colours and those of finished components go, and the rest starts again. A round costs the edges that are
    left, never pairs of nodes; the number of rounds follows the longest path that no trimming shortens.
    """
    live, left = trimmed(settled(edges.select("src", "dst").filter("src <> dst").distinct()))
    parts = []
    while left:
        colours = least_sources(live)
        of = lambda c, colours=colours: colours.select(F.col("node").alias(c), F.col("colour").alias(f"{c}_colour"))
        same = settled(live.join(of("src"), "src").join(of("dst"), "dst").filter("src_colour = dst_colour").select("src", "dst"))
        found = Rounds(colours.filter("node = colour"))
        while not found.new.isEmpty():
            back = found.new.join(same, F.col("node") == F.col("dst")).select(F.col("src").alias("node"), "colour").distinct()
            found.add(back.join(found.known, "node", "left_anti"))
        parts.append(found.known)
        done = found.known.select("node")
        live, left = trimmed(settled(same.join(done.withColumnRenamed("node", "src"), "src", "left_anti").join(done.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")))
    if not parts:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.select("node").join(reduce(DataFrame.union, parts), "node", "left").select("node", F.coalesce("colour", "node").alias("component"))


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def paths(edges: DataFrame, most: int, seed: DataFrame | None = None) -> DataFrame:
    """path: arrays of 2 to `most` distinct nodes joined by edges: acyclic call paths."""
    e = edges.select("src", "dst").distinct()
    first = e if seed is None else e.join(seed.select("src").distinct(), "src", "left_semi")
    now = settled(first.select(F.array("src", "dst").alias("path")))
    out = now
    for _ in range(most - 2):
        now = now.join(e, F.element_at("path", -1) == F.col("src")).filter(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
        now = settled(now)
        out = out.unionByName(now)
    return out


def leaves_by_level(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """level, leaf: nodes without children below each root, with their shortest depth."""
    down = closure(edges, roots.select(F.col("node").alias("src")))
    return down.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_anti").groupBy(F.col("dst").alias("leaf")).agg(F.min("depth").alias("level"))


def resolved_calls(calls: DataFrame, methods: DataFrame, overrides: DataFrame) -> DataFrame:
    """Call edges (src, dst) with abstract or overridden callees replaced by what overrides them, and without native ones.

    methods: member, is_abstract, is_native; overrides: member, by.
    """
    o = overrides.select(F.col("member").alias("dst"), "by")
    direct = calls.join(methods.select(F.col("member").alias("dst"), "is_abstract", "is_native"), "dst", "left").join(o, "dst", "left")
    return direct.filter(~F.coalesce("is_native", F.lit(False))).filter(F.col("by").isNotNull() | ~F.coalesce("is_abstract", F.lit(False))).select("src", F.coalesce("by", "dst").alias("dst")).distinct()


def transitive_uses(calls: DataFrame, uses: DataFrame, most: int = 3) -> DataFrame:
    """member, field: fields used by a method or by what it calls, up to `most` calls deep."""
    reach = closure(calls, most=most).select(F.col("src").alias("member"), F.col("dst").alias("callee"))
    far = reach.join(uses.select(F.col("member").alias("callee"), "field"), "callee").select("member", "field")
    return uses.select("member", "field").unionByName(far).distinct()


def region_edges(edges: DataFrame, region: DataFrame) -> DataFrame:
    """Edges (g, src, dst, dep, var, loop_id) inside a region (g, node); loop-carried ones need their loop's header inside too."""
    inside = region.select("g", "node").distinct()
    out = edges.join(inside.withColumnRenamed("node", "src"), ["g", "src"], "left_semi").join(inside.withColumnRenamed("node", "dst"), ["g", "dst"], "left_semi")
    loops = inside.select("g", F.col("node").alias("loop_id"))
    return out.filter("loop_id IS NULL").unionByName(out.filter("loop_id IS NOT NULL").join(loops, ["g", "loop_id"], "left_semi").select(*out.columns))


def backward_slice(edges: DataFrame, criteria: DataFrame) -> DataFrame:
    """criterion, node: what a criterion depends on, itself included, over dependence edges (src, dst) read backwards."""
    back = closure(reversed_edges(edges), criteria.select(F.col("node").alias("src")))
    return back.select(F.col("src").alias("criterion"), F.col("dst").alias("node")).unionByName(criteria.select(F.col("node").alias("criterion"), "node")).distinct()


def blocks(nodes: DataFrame, graph: str, order: str, leader: str) -> DataFrame:
    """nodes with block (from 1): a new one at each leader and at the first node of a graph."""
    from pyspark.sql import Window as W

    w = W.partitionBy(graph).orderBy(order)
    starts = (F.row_number().over(w) == 1) | F.col(leader)
    return nodes.withColumn("__s", starts.cast("int")).withColumn("block", F.sum("__s").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__s")


def reachable_blocks(flow: DataFrame) -> DataFrame:
    """src, dst: blocks reachable forwards without loop-back edges (src, dst, loopback), each reaching itself."""
    forward = flow.filter(~F.col("loopback")).select("src", "dst")
    every = flow.select(F.explode(F.array("src", "dst")).alias("src")).distinct().select("src", F.col("src").alias("dst"))
    return closure(forward).select("src", "dst").unionByName(every).distinct()


def boundary_blocks(reachable: DataFrame, dominated: DataFrame) -> DataFrame:
    """node_block, boundary: blocks from which a block is reachable and which dominate it."""
    return reachable.join(dominated, ["src", "dst"]).select(F.col("dst").alias("node_block"), F.col("src").alias("boundary")).distinct()


def dominated(control: DataFrame) -> DataFrame:
    """src, dst: what runs only under a node, by control dependences (src, dst), each node under itself."""
    every = control.select(F.explode(F.array("src", "dst")).alias("src")).distinct().select("src", F.col("src").alias("dst"))
    return closure(control).select("src", "dst").unionByName(every).distinct()


def block_region(blocks_of: DataFrame, reachable: DataFrame, boundary: DataFrame) -> DataFrame:
    """boundary, node: nodes of the blocks reachable from a boundary block. blocks_of: block, node; boundary: boundary."""
    return boundary.join(reachable, F.col("boundary") == F.col("src")).join(blocks_of, F.col("dst") == F.col("block")).select("boundary", "node").distinct()


def container_paths(associations: DataFrame, most: int) -> DataFrame:
    """path, container: chains of associations (from_class, to_class, is_container) and whether one of them holds many."""
    edges = associations.groupBy(F.col("from_class").alias("src"), F.col("to_class").alias("dst")).agg(F.bool_or("is_container").alias("many"))
    now = settled(edges.select(F.array("src", "dst").alias("path"), F.col("many").alias("container")))
    out = now
    for _ in range(most - 2):
        now = settled(now.join(edges, F.element_at("path", -1) == F.col("src")).filter(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), (F.col("container") | F.col("many")).alias("container")))
        out = out.unionByName(now)
    return out


def sub_types(extends: DataFrame, abstract: DataFrame) -> DataFrame:
    """type, sub: sub-types of a type (extends: sub, super); abstract ones are followed to theirs and stay out themselves."""
    down = closure(extends.select(F.col("super").alias("src"), F.col("sub").alias("dst")))
    return down.join(abstract.select(F.col("type").alias("dst")), "dst", "left_anti").select(F.col("src").alias("type"), F.col("dst").alias("sub"))
