"""Connected components of a distributed graph, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node, label for each node of edges (a, b): label is the least node of its component.

    Each round every node points to its least neighbour or itself, pointers are followed once more, and edges are carried to
    where their ends point; what is left shrinks at least by half, and stars vanish in one round. No group is gathered:
    only minima are, which combine before they move. Each round is written, so its lineage ends there.
    """
    edges = edges.filter("a <> b").select("a", "b")
    graph = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = None
    for _ in range(most):
        if graph.isEmpty():
            break
        least = graph.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("to"))
        least = written(least, "least")
        # A node that others point to is in the graph itself, so each pointer can be followed.
        hop = least.select(F.col("node").alias("mid"), F.col("to").alias("far"))
        point = written(least.join(hop, F.col("to") == F.col("mid")).select("node", F.col("far").alias("to")), "point")
        if labels is None:
            labels = point.select("node", F.col("to").alias("label"))
        else:
            on = point.select(F.col("node").alias("via"), "to")
            labels = written(labels.join(on, F.col("label") == F.col("via"), "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        p, q = point.select(F.col("node").alias("n1"), F.col("to").alias("t1")), point.select(F.col("node").alias("n2"), F.col("to").alias("t2"))
        moved = graph.join(p, F.col("a") == F.col("n1")).join(q, F.col("b") == F.col("n2"))
        graph = written(moved.filter("t1 <> t2").select(F.col("t1").alias("a"), F.col("t2").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError("components: no end after many rounds")
    return labels if labels is not None else graph.select(F.col("a").alias("node"), F.col("b").alias("label"))
