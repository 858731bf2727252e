"""What statements and calls do to objects: alias sets over branching flow, dependences through them, and side effects of calls.

Aliases need a work list over the flow of one method, so each method is a row of a kernel. Side effects travel over the calls
of all methods at once, a call deep a round.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flow import some
from .graph import settled

Assign = dict[int, tuple[str, str | None]]


def aliases(flow: dict[int, list[int]], assigns: Assign) -> dict[int, set[tuple[str, str]]]:
    """Pairs of variables that may name one object after each node, along some path of the flow.

    An assignment x = y ends what x was an alias of, and makes it one of y and of all of y's; x = None names a new object.
    """
    after: dict[int, set[tuple[str, str]]] = defaultdict(set)
    todo: deque = deque()

    def put(node: int, a: str, b: str) -> None:
        pair = (a, b) if a < b else (b, a)
        if a != b and pair not in after[node]:
            after[node].add(pair)
            todo.append((node, pair))

    for node, (x, y) in assigns.items():
        if y is not None:
            put(node, x, y)
    while todo:
        node, (a, b) = todo.popleft()
        for to in flow.get(node, ()):
            x, y = assigns.get(to, (None, None))
            if x is None or x == y or x not in (a, b):
                put(to, a, b)
            if x is not None and x != y and y in (a, b) and x not in (a, b):
                put(to, x, b if y == a else a)
    return after


def field_dependences(flow: dict[int, list[int]], assigns: Assign, defs: dict[int, list[tuple[str, str]]], uses: dict[int, list[tuple[str, str]]]) -> set[tuple[int, int, str, str]]:
    """(definition, use, variable used, field): uses of v.f that may read what a definition of w.f wrote.

    A written field is known by the variable it was written through and by that one's aliases there; assignments copy and drop
    names as they do aliases, and a definition of v.f drops what v.f held before.
    """
    known = aliases(flow, assigns)
    out, seen, todo = set(), set(), deque()

    def put(at: int, d: int, v: str, f: str) -> None:
        if (at, d, v, f) not in seen:
            seen.add((at, d, v, f))
            todo.append((at, d, v, f))

    for d, written in defs.items():
        for v, f in written:
            put(d, d, v, f)
            for a, b in known.get(d, ()):
                if v in (a, b):
                    put(d, d, b if v == a else a, f)
    while todo:
        at, d, v, f = todo.popleft()
        for to in flow.get(at, ()):
            if (v, f) in uses.get(to, ()):
                out.add((d, to, v, f))
            x, y = assigns.get(to, (None, None))
            gone = (x == v and y != v) or (v, f) in defs.get(to, ())
            if not gone:
                put(to, d, v, f)
            if x is not None and x != v and y == v and (v, f) not in defs.get(to, ()):
                put(to, d, x, f)
    return out


def _by_method(flow: DataFrame, assigns: DataFrame, defs: DataFrame | None = None, uses: DataFrame | None = None) -> DataFrame:
    """g and what a method has, as arrays: one row a method."""
    rows = lambda df, *cols: df.groupBy("g").agg(F.collect_list(F.struct(*cols)).alias("r"))
    out = rows(flow.distinct(), "src", "dst").withColumnRenamed("r", "flow").join(rows(assigns, "node", "left", "right").withColumnRenamed("r", "assigns"), "g", "full")
    for name, df in (("defs", defs), ("uses", uses)):
        if df is not None:
            out = out.join(rows(df.distinct(), "node", "var", "field").withColumnRenamed("r", name), "g", "full")
    return out


def _read(row: dict) -> tuple[dict[int, list[int]], Assign]:
    flow = defaultdict(list)
    for e in row["flow"] or ():
        flow[e["src"]].append(e["dst"])
    return flow, {a["node"]: (a["left"], a["right"]) for a in row["assigns"] or ()}


def alias_pairs(flow: DataFrame, assigns: DataFrame) -> DataFrame:
    """g, node, a, b: variables that may be aliases after a node; flow: g, src, dst; assigns: g, node, left, right (or null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some(batches):
            for row in batch.to_pylist():
                found = [(n, *p) for n, pairs in aliases(*_read(row)).items() for p in pairs]
                cols = list(zip(*found, strict=True)) or [[], [], []]
                g = pa.array([row["g"]] * len(found), batch.schema.field("g").type)
                yield pa.RecordBatch.from_arrays([g, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["g", "node", "a", "b"])

    kind = flow.schema["g"].dataType.simpleString()
    return _by_method(flow, assigns).mapInArrow(run, f"g {kind}, node long, a string, b string")


def aliased_dependences(flow: DataFrame, assigns: DataFrame, defs: DataFrame, uses: DataFrame) -> DataFrame:
    """g, src, dst, var, field: data dependences of fields (g, node, var, field) along the flow, through aliases too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in some(batches):
            for row in batch.to_pylist():
                at = lambda name, row=row: {n: [(x["var"], x["field"]) for x in row[name] or () if x["node"] == n] for n in {x["node"] for x in row[name] or ()}}
                found = sorted(field_dependences(*_read(row), at("defs"), at("uses")))
                cols = list(zip(*found, strict=True)) or [[]] * 4
                g = pa.array([row["g"]] * len(found), batch.schema.field("g").type)
                yield pa.RecordBatch.from_arrays([g, *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], names=["g", "src", "dst", "var", "field"])

    kind = flow.schema["g"].dataType.simpleString()
    return _by_method(flow, assigns, defs, uses).mapInArrow(run, f"g {kind}, src long, dst long, var string, field string")


def side_effects(direct: DataFrame, bindings: DataFrame, most_calls: int = 3, most_parts: int = 3) -> DataFrame:
    """method, root, path, mode, calls: fields that a method reads or writes of `this` and of its parameters, itself (0 calls
    deep) or through calls up to `most_calls` deep.

    direct: method, root (`this`, `p1`, ...), path (array of field names), mode. bindings: caller, callee, slot (the callee's
    `this` or parameter), root and path (what the caller passes there). Paths of more than `most_parts` fields are left out,
    so recursion over growing structures ends; recursion that finds nothing new ends by itself.
    """
    now = settled(direct.select("method", "root", "path", "mode").distinct().filter(F.size("path") <= most_parts).withColumn("calls", F.lit(0)))
    out, key = now, ["method", "root", "path", "mode"]
    into = bindings.select("caller", F.col("callee").alias("method"), F.col("slot").alias("root"), F.col("root").alias("to"), F.col("path").alias("before")).distinct()
    for depth in range(1, most_calls + 1):
        new = now.join(into, ["method", "root"]).select(F.col("caller").alias("method"), F.col("to").alias("root"), F.concat("before", "path").alias("path"), "mode")
        now = settled(new.filter(F.size("path") <= most_parts).distinct().join(out.select(*key), key, "left_anti").withColumn("calls", F.lit(depth)))
        if now.isEmpty():
            break
        out = out.unionByName(now)
    return out
