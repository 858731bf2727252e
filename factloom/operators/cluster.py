"""Single-linkage clustering of a class's entities, and concepts from overlapping candidates."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components


def snapshots(distance: np.ndarray) -> list[tuple[int, ...]]:
    """Clusters of more than one entity seen while the two nearest clusters merge, until two are left or none is nearer than 1.

    The first of equal minima counts, rows before columns. A cluster that grows by a single entity withdraws its earlier
    snapshot, and with two clusters left nothing is recorded if either is a single entity.
    """
    i, j = np.nonzero(np.tri(len(distance), k=-1, dtype=bool))
    return linked(len(distance), i, j, distance[i, j].astype(float))


def linked(n: int, a: np.ndarray, b: np.ndarray, dist: np.ndarray) -> list[tuple[int, ...]]:
    """The snapshots of n entities of which the pairs (a, b) have these distances, all others 1. Memory follows the pairs.

    Clusters are known by their least entity, which is their place among the clusters. Distances of clusters are least ones, so
    those of one value are worked off before any larger one. Within a value the first row with a cluster before it merges into
    the first such cluster, and the others before it follow, in order; so rows are taken once, in ascending order.
    """
    near = (dist < 1) & (a != b)
    order = np.argsort(dist[near], kind="stable")
    a, b, dist = a[near][order].tolist(), b[near][order].tolist(), dist[near][order]
    ends = [0, *(np.flatnonzero(np.diff(dist)) + 1).tolist(), len(a)]
    head, clusters, left = list(range(n)), {k: (k,) for k in range(n)}, n
    seen: dict[int, tuple[int, ...]] = {}
    last: dict[int, int] = {}

    def find(x: int) -> int:
        while head[x] != x:
            head[x] = x = head[head[x]]
        return x

    for begin, end in zip(ends, ends[1:]):
        rows: dict[int, set[int]] = {}
        for k in range(begin, end):
            x, y = find(a[k]), find(b[k])
            if x != y:
                rows.setdefault(max(x, y), set()).add(min(x, y))
        for i in sorted(rows):
            j, *more = sorted({find(y) for y in rows[i]})
            for k in (i, *more):
                if left <= 2:
                    return list(seen.values())
                one, two = clusters[j], clusters.pop(k)
                if len(two) == 1 < len(one):
                    seen.pop(last[j])
                elif len(one) == 1 < len(two):
                    seen.pop(last[k])
                head[k], clusters[j], left = j, one + two, left - 1
                if left > 2 or min(map(len, clusters.values())) > 1:
                    last[j] = n - left
                    seen[last[j]] = clusters[j]
    return list(seen.values())


def hierarchical(entities: DataFrame, distances: DataFrame) -> DataFrame:
    """class, cluster (from 1), entities: every snapshot of each class.

    entities: class, entity, position (attributes before methods); distances: class, a, b, dist for pairs nearer than 1.
    A class is one task's work: its entities are the members of one class of source code. It holds the pairs that are given,
    never all pairs of its entities.
    """
    items = entities.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("position", "entity"))).alias("items"))
    pairs = distances.filter("dist < 1").groupBy("class").agg(F.collect_list(F.struct("a", "b", "dist")).alias("pairs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for r in range(whole.num_rows):
                row = whole.slice(r, 1)
                _, names = row.column(1).flatten().flatten()
                a, b, dist = row.column(2).flatten().flatten()
                at = lambda c: pc.index_in(c, names).to_numpy(zero_copy_only=False).astype(np.int64)
                found = linked(len(names), at(a), at(b), dist.to_numpy(zero_copy_only=False).astype(float))
                ends = np.cumsum([0, *map(len, found)])
                members = names.take(pa.array(np.fromiter(chain.from_iterable(found), np.int64, ends[-1])))
                yield pa.RecordBatch.from_arrays([pa.repeat(row.column(0)[0], len(found)), pa.array(range(1, len(found) + 1), pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), members)], names=["class", "cluster", "entities"])

    return items.join(pairs, "class", "left").mapInArrow(run, "class string, cluster int, entities array<string>")


def concepts(candidates: DataFrame) -> DataFrame:
    """candidates (candidate, entity) -> candidate, concept: candidates that overlap, however far round, share the least one's id."""
    pairs = candidates.select("entity", "candidate").distinct()
    hubs = pairs.groupBy("entity").agg(F.min("candidate").alias("b"))
    edges = pairs.join(hubs, "entity").select(F.col("candidate").alias("a"), "b").distinct()
    nodes = candidates.select(F.col("candidate").alias("node")).distinct()
    return components(edges, nodes).select(F.col("node").alias("candidate"), F.col("component").alias("concept"))


def absorb_fields(candidates: DataFrame) -> DataFrame:
    """Groups of type-check candidates (candidate, field) that share static fields, with the fields each lacks of its group's."""
    group = concepts(candidates.select("candidate", F.col("field").alias("entity")))
    own = candidates.join(group, "candidate")
    size = group.groupBy("concept").agg(F.count(F.lit(1)).alias("members"))
    union = own.select("concept", "field").distinct()
    every = group.join(union, "concept")
    lacks = every.join(candidates.select("candidate", "field"), ["candidate", "field"], "left_anti").groupBy("candidate").agg(F.array_sort(F.collect_list("field")).alias("additional"))
    return group.join(size, "concept").join(lacks, "candidate", "left").select("candidate", "concept", F.when(F.col("members") > 1, F.coalesce("additional", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("additional"))
