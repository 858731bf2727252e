"""Control flow and dependences of method bodies.

A method is a list of statement rows (id, parent, ordinal, kind, defs, uses, declares, label), ids in textual order. Kinds:
simple, if, then, else, while, for, do, switch, case, default, try, catch, finally, block, break, continue, return, throw.
A method is one task's work, in Arrow batches; methods are independent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LOOPS = ("while", "for", "do")
GROUPS = ("then", "else", "block", "case", "default", "catch", "finally")


@dataclass
class Statement:
    id: int
    parent: int | None
    kind: str
    defs: tuple[str, ...] = ()
    uses: tuple[str, ...] = ()
    declares: tuple[str, ...] = ()
    label: str | None = None
    children: list[Statement] = field(default_factory=list)


def tree(rows: list[Statement]) -> list[Statement]:
    """The roots, with children in order of id."""
    by = {s.id: s for s in rows}
    roots = []
    for s in sorted(rows, key=lambda s: s.id):
        s.children = []
        (by[s.parent].children if s.parent in by else roots).append(s)
    return roots


Edge = tuple[int, int, bool, str | None]


class Flow:
    """Flow edges (src, dst, loop-back, branch) of a method. A loose end is a node with the branch that leaves it."""

    def __init__(self, roots: list[Statement]):
        self.edges: dict[Edge, None] = {}
        self.breaks: list[tuple[str | None, list]] = []
        self.loops: list[tuple[str | None, int]] = []
        self.exits = self._sequence(roots, [])

    def _join(self, ends: list, to: int, back: bool = False) -> None:
        for node, branch in ends:
            self.edges[node, to, back, branch] = None

    def _sequence(self, body: list[Statement], ends: list) -> list:
        for s in body:
            ends = self._one(s, ends)
        return ends

    def _part(self, s: Statement, kinds: tuple[str, ...]) -> list[Statement] | None:
        found = [c for c in s.children if c.kind in kinds]
        return [x for c in found for x in c.children] if found else None

    def _one(self, s: Statement, ends: list) -> list:
        if s.kind in ("block", "finally"):
            return self._sequence(s.children, ends)
        if s.kind == "try":
            guarded = [c for c in s.children if c.kind not in ("catch", "finally")]
            done = self._sequence(guarded, ends)
            last = next((c for c in s.children if c.kind == "finally"), None)
            return self._sequence(last.children, done) if last else done
        if s.kind == "do":
            self.breaks.append((s.label, []))
            self.loops.append((s.label, s.id))
            done = self._sequence(s.children, ends)
            self.loops.pop()
            self._join(done, s.id)
            first = self._first(s)
            if first is not None:
                self.edges[s.id, first, True, "true"] = None
            return [(s.id, "false"), *self.breaks.pop()[1]]
        self._join(ends, s.id)
        if s.kind == "if":
            then, other = self._part(s, ("then",)), self._part(s, ("else",))
            a = self._sequence(then or [], [(s.id, "true")])
            return a + (self._sequence(other, [(s.id, "false")]) if other is not None else [(s.id, "false")])
        if s.kind in LOOPS:
            self.breaks.append((s.label, []))
            self.loops.append((s.label, s.id))
            done = self._sequence(s.children, [(s.id, "true")])
            self.loops.pop()
            self._join(done, s.id, True)
            return [(s.id, "false"), *self.breaks.pop()[1]]
        if s.kind == "switch":
            self.breaks.append((s.label, []))
            falling, default = [], False
            for c in s.children:
                default |= c.kind == "default"
                falling = self._sequence(c.children, [*falling, (s.id, "true")])
            out = falling + self.breaks.pop()[1]
            return out if default else [*out, (s.id, "false")]
        if s.kind in ("return", "throw"):
            return []
        if s.kind == "break":
            for label, waiting in reversed(self.breaks):
                if s.label is None or s.label == label:
                    waiting.append((s.id, None))
                    break
            return []
        if s.kind == "continue":
            for label, head in reversed(self.loops):
                if s.label is None or s.label == label:
                    self.edges[s.id, head, True, None] = None
                    break
            return []
        return [(s.id, None)]

    def _first(self, s: Statement) -> int | None:
        for c in s.children:
            if c.kind in ("block", "finally", "try", "do"):
                inner = self._first(c)
                if inner is not None:
                    return inner
                if c.kind == "do":
                    return c.id
            else:
                return c.id
        return None


Dependence = tuple[int, int, str, str | None, int | None]


def control_dependences(rows: list[Statement]) -> list[Dependence]:
    """Each statement depends on the nearest statement around it that decides whether it runs; 0 is the method's entry."""
    by = {s.id: s for s in rows}
    out = []
    for s in rows:
        if s.kind in GROUPS or s.kind == "try":
            continue
        up = s.parent
        while up in by and (by[up].kind in GROUPS or by[up].kind == "try"):
            up = by[up].parent
        out.append((up if up in by else 0, s.id, "control", None, None))
    return out


class ThrowingFlow(Flow):
    """A flow with exceptions: a throw runs into the catch clauses of the nearest try that has some, from within that try's
    guarded part, and what a catch leaves runs on after the try. Any guarded statement may end in a catch, but only throws are
    linked to one; a catch that no throw reaches is entered from the try's first statement, on the branch `throw`."""

    def __init__(self, roots: list[Statement]):
        self.waiting: list[list[int]] = []
        super().__init__(roots)

    def _one(self, s: Statement, ends: list) -> list:
        if s.kind == "throw" and self.waiting:
            self._join(ends, s.id)
            self.waiting[-1].append(s.id)
            return []
        catches = [c for c in s.children if c.kind == "catch"] if s.kind == "try" else []
        if not catches:
            return super()._one(s, ends)
        guarded = [c for c in s.children if c.kind not in ("catch", "finally")]
        self.waiting.append([])
        done = self._sequence(guarded, ends)
        thrown = self.waiting.pop() or [n for n in [self._first(s)] if n is not None]
        for c in catches:
            done = done + self._sequence(c.children, [(n, "throw") for n in thrown])
        last = next((c for c in s.children if c.kind == "finally"), None)
        return self._sequence(last.children, done) if last else done


ENTRY, EXIT = 0, -1


def post_dominators(follow: dict[int, list[int]]) -> dict[int, set[int]]:
    """For each node all nodes that every way from it to EXIT passes, itself included. A node from which EXIT isn't reached, in
    an endless loop, counts as if the loop could end there, from the largest node on."""
    nodes = {EXIT, *follow, *(d for out in follow.values() for d in out)}
    follow = {n: list(follow.get(n, ())) for n in nodes}
    back: dict[int, list[int]] = {n: [] for n in nodes}
    for s, out in follow.items():
        for d in out:
            back[d].append(s)
    reached, todo = set(), [EXIT]
    while True:
        while todo:
            n = todo.pop()
            if n not in reached:
                reached.add(n)
                todo.extend(back[n])
        if len(reached) == len(nodes):
            break
        stuck = max(nodes - reached)
        follow[stuck].append(EXIT)
        back[EXIT].append(stuck)
        todo.append(stuck)
    out = {n: set(nodes) for n in nodes}
    out[EXIT] = {EXIT}
    todo = list(nodes)
    while todo:
        n = todo.pop()
        if n != EXIT and (new := {n} | set.intersection(*(out[d] for d in follow[n]))) != out[n]:
            out[n] = new
            todo.extend(back[n])
    return out


def controlled(edges: list[tuple[int, int, str | None]]) -> set[tuple[int, int, str | None]]:
    """(src, dst, branch): dst runs if src takes that branch, and might not run otherwise. edges include those from ENTRY and to
    EXIT; what always runs depends on ENTRY."""
    follow: dict[int, list[int]] = {ENTRY: [EXIT]}
    for s, d, _ in edges:
        follow.setdefault(s, []).append(d)
    after = post_dominators(follow)
    return {(s, x, branch) for s, d, branch in edges for x in after[d] - (after[s] - {s}) if x != EXIT}


def jump_dependences(rows: list[Statement]) -> list[Dependence]:
    """Control dependences by post-dominance over the flow, so that cases, breaks, continues, returns and throws count: what
    runs only if a jump isn't taken depends on what decides about the jump."""
    roots = tree(rows)
    flow = ThrowingFlow(roots)
    edges = [(s, d, branch) for s, d, _, branch in flow.edges]
    ends = {s for s, _, _ in edges}
    nodes = {*ends, *(d for _, d, _ in edges), *(s.id for s in rows if s.kind in ("return", "throw")), *(n for n, _ in flow.exits)}
    edges += [(n, EXIT, branch) for n, branch in flow.exits] + [(n, EXIT, None) for n in nodes - ends - {n for n, _ in flow.exits}]
    top = Statement(ENTRY, None, "block", children=roots)
    first = flow._first(top)
    if first is not None:
        edges.append((ENTRY, first, None))
    return sorted({(s, d, "control", None, None) for s, d, _ in controlled(edges)})


def some(batches: Iterator[pa.RecordBatch], rows: int = 16) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few methods, so that only few are Python objects at a time."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def control_edges(flow: DataFrame) -> DataFrame:
    """g, src, dst, branch: control dependences by post-dominance of flow graphs (g, src, dst, branch) with ENTRY and EXIT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some(batches):
            for g, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = sorted(controlled([(r["src"], r["dst"], r["branch"]) for r in rows]), key=lambda e: (e[0], e[1], e[2] or ""))
                cols = list(zip(*found, strict=True)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(found), b.schema.field(0).type), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["g", "src", "dst", "branch"])

    kind = flow.schema["g"].dataType.simpleString()
    return flow.groupBy("g").agg(F.collect_list(F.struct("src", "dst", "branch")).alias("r")).mapInArrow(run, f"g {kind}, src long, dst long, branch string")


def data_dependences(rows: list[Statement], edges: list[Edge]) -> list[Dependence]:
    """Data (definition to use), anti (use to definition) and output (definition to definition) dependences.

    From each origin the flow is walked until the variable is defined again; crossing a loop-back edge tags what follows
    with the loop. A definition that declares the variable also keeps its order before the next definition.
    """
    by = {s.id: s for s in rows}
    follow: dict[int, list[tuple[int, bool]]] = {}
    for src, dst, back, _ in edges:
        follow.setdefault(src, []).append((dst, back))
    out: dict[Dependence, None] = {}

    def walk(origin: int, var: str, kind: str) -> None:
        seen, todo = set(), [(origin, None)]
        while todo:
            node, loop = todo.pop()
            for dst, back in follow.get(node, ()):
                tag = dst if back else loop
                s = by[dst]
                if kind == "data" and var in s.uses:
                    out[origin, dst, "data", var, tag] = None
                if var in s.defs:
                    if kind != "data":
                        out[origin, dst, kind, var, tag] = None
                    elif var in by[origin].declares and dst != origin:
                        out[origin, dst, "data", var, tag] = None
                elif dst not in seen:
                    todo.append((dst, tag))
                seen.add(dst)

    for s in rows:
        for v in s.defs:
            walk(s.id, v, "data")
            walk(s.id, v, "output")
        for v in s.uses:
            walk(s.id, v, "anti")
    return list(out)


def alias_sets(steps: list[tuple[str, str | None]]) -> list[frozenset[str]]:
    """Alias sets after a straight sequence of assignments (variable, variable or None for a new value)."""
    sets: list[set[str]] = []
    for left, right in steps:
        for s in sets:
            s.discard(left)
        if right is not None and right != left:
            home = next((s for s in sets if right in s), None)
            if home is None:
                sets.append(home := {right})
            home.add(left)
        sets = [s for s in sets if len(s) > 1]
    return [frozenset(s) for s in sets]


ROW = "array<struct<id:int,parent:int,kind:string,defs:array<string>,uses:array<string>,declares:array<string>,label:string>>"
FLOW_EDGES = "g string, src int, dst int, loopback boolean, branch string"
PDG_EDGES = "g string, src int, dst int, dep string, var string, loop_id int"


def _statements(rows: list[dict]) -> list[Statement]:
    return [Statement(r["id"], r["parent"], r["kind"], tuple(r["defs"] or ()), tuple(r["uses"] or ()), tuple(r["declares"] or ()), r["label"]) for r in rows]


def _batch(out: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)


def methods(statements: DataFrame) -> DataFrame:
    """g, rows: the statements of each method together."""
    cols = ["id", "parent", "kind", "defs", "uses", "declares", "label"]
    return statements.groupBy("g").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("rows"))


def flow_edges(statements: DataFrame) -> DataFrame:
    """The flow graph of each method: g, src, dst, loopback, branch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some(batches):
            out = [(g, *e) for g, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for e in Flow(tree(_statements(rows))).edges]
            yield _batch(out, [pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string()], ["g", "src", "dst", "loopback", "branch"])

    return methods(statements).mapInArrow(run, FLOW_EDGES)


def dependence_edges(statements: DataFrame, jumps: bool = False) -> DataFrame:
    """The dependence graph of each method: g, src, dst, dep (control, data, anti, output), var, loop_id.

    With jumps, control dependences and the flow count breaks, returns, throws and catches; else control follows nesting.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in some(batches):
            out = []
            for g, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = _statements(rows)
                edges = list((ThrowingFlow if jumps else Flow)(tree(s)).edges)
                control = jump_dependences(s) if jumps else control_dependences(s)
                out += [(g, *d) for d in (*control, *data_dependences(s, edges))]
            yield _batch(out, [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32()], ["g", "src", "dst", "dep", "var", "loop_id"])

    return methods(statements).mapInArrow(run, PDG_EDGES)


def straight_dependences(events: DataFrame, graph: str, order: str, node: str, is_def, is_use) -> dict[str, DataFrame]:
    """Dependences where the flow is a line and there is one variable: the nearest definition before and after, by windows.

    data: (g, def, use); anti: (g, use, def); output: (g, def, next def).
    """
    w = W.partitionBy(graph).orderBy(order)
    before = F.last(F.when(is_def, F.col(node)), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    after = F.first(F.when(is_def, F.col(node)), ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing))
    x = events.select(F.col(graph).alias("g"), F.col(node).alias("node"), before.alias("before"), after.alias("after"), is_def.alias("d"), is_use.alias("u"))
    return {
        "data": x.filter("u AND before IS NOT NULL").select("g", F.col("before").alias("src"), F.col("node").alias("dst")),
        "anti": x.filter("u AND after IS NOT NULL").select("g", F.col("node").alias("src"), F.col("after").alias("dst")),
        "output": x.filter("d AND after IS NOT NULL").select("g", F.col("node").alias("src"), F.col("after").alias("dst")),
    }


def slice_unions(slices: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """g, var, block, node, role of a slice union (g, var, block, node): duplicated or removable, and remaining for the rest.

    A slice's node is indispensable, so duplicated, if what remains depends on it by control or by data of another variable.
    """
    key = ["g", "var", "block"]
    rest = slices.select(*key).distinct().join(nodes, "g").join(slices, [*key, "node"], "left_anti")
    into = edges.filter("dep IN ('control', 'data')").select("g", F.col("src").alias("node"), F.col("dst").alias("to"), "dep", F.col("var").alias("on"))
    need = slices.join(into, ["g", "node"]).filter((F.col("dep") == "control") | (F.col("on") != F.col("var"))).join(rest.withColumnRenamed("node", "to"), [*key, "to"], "left_semi").select(*key, "node").distinct()
    marked = slices.join(need.withColumn("needed", F.lit(True)), [*key, "node"], "left")
    roles = marked.select(*key, "node", F.when(F.col("needed"), "duplicated").otherwise("removable").alias("role"))
    return roles.unionByName(rest.select(*key, "node", F.lit("remaining").alias("role")))


def slice_sizes(roles: DataFrame) -> DataFrame:
    """Statements extracted and duplicated by each slice union, and their ratio."""
    n = lambda *r: F.count_if(F.col("role").isin(*r))
    return roles.groupBy("g", "var", "block").agg(n("removable", "duplicated").alias("extracted"), n("duplicated").alias("duplicated")).withColumn("ratio", F.col("duplicated") / F.greatest(F.lit(1), F.col("extracted")))


def slice_passes(sizes: DataFrame, method_size: DataFrame, t) -> DataFrame:
    """Slices within the thresholds of size and duplication."""
    x = sizes.join(method_size, "g")
    return x.filter((F.col("extracted") >= t.min_slice) & (F.col("extracted") <= F.col("size") - t.max_slice_slack) & (F.col("duplicated") <= t.max_duplication) & (F.col("ratio") <= t.max_duplication_ratio) & (F.col("size") >= t.min_method_size))


def slice_criteria(statements: DataFrame) -> DataFrame:
    """g, var, node: assignments of a variable, without its declaration."""
    d = statements.select("g", F.col("id").alias("node"), F.explode("defs").alias("var"), F.coalesce("declares", F.array().cast("array<string>")).alias("declares"))
    return d.filter(~F.array_contains("declares", F.col("var"))).select("g", "var", "node")


def common_boundaries(boundaries: DataFrame) -> DataFrame:
    """g, var, block: blocks that are a boundary of every criterion (g, var, node, block) of a variable."""
    need = boundaries.select("g", "var", "node").distinct().groupBy("g", "var").agg(F.count(F.lit(1)).alias("need"))
    met = boundaries.select("g", "var", "node", "block").distinct().groupBy("g", "var", "block").agg(F.count(F.lit(1)).alias("met"))
    return met.join(need, ["g", "var"]).filter("met = need").select("g", "var", "block")
