"""Operators on hand-computed cases and properties."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.functions import names
from factloom.operators import candidates, clones, cluster, evolution, facts, flow, graph, joins, metrics


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


# --- metrics

def test_lack_of_cohesion(spark):
    f = spark.createDataFrame([("A", "x"), ("A", "y")], "class string, field string")
    m = spark.createDataFrame([("A", "m1"), ("A", "m2"), ("A", "m3"), ("B", "m")], "class string, method string")
    u = spark.createDataFrame([("A", "m1", "x"), ("A", "m2", "x"), ("A", "m2", "y"), ("A", "m2", "y")], "class string, method string, field string")
    out = metrics.lack_of_cohesion(f, m, u)
    assert rows(out, "class", "lcom2", "lcom3") == [("A", 0.5, 0.75), ("B", None, None)]
    assert rows(metrics.system_average(out, "lcom2", "a")) == [(0.5,)]
    assert rows(metrics.system_average(out.filter("class = 'B'"), "lcom2", "a")) == [(0.0,)]
    calls = spark.createDataFrame([("A", "m3", "m1"), ("A", "m1", "m1")], "class string, caller string, callee string")
    got = {r["class"]: r["connectivity"] for r in metrics.connectivity(m, u, calls).collect()}
    assert got["A"] == pytest.approx(2 / 3) and got["B"] is None


def test_coupling(spark):
    c = spark.createDataFrame([("A",), ("B",), ("C",)], "class string")
    a = spark.createDataFrame([("A", "B")] * 3 + [("A", "C")] + [("B", "A")] * 2 + [("A", "A")] * 9, "src string, dst string")
    assert rows(metrics.average_coupling(c, a)) == [("A", 2.0), ("B", 1.0), ("C", 0.0)]
    assert rows(metrics.system_average(metrics.average_coupling(c, a), "coupling", "x")) == [(1.0,)]
    assert rows(metrics.average_coupling(c.limit(1), a.limit(0)))[0][1] is None
    m = {(r["src"], r["dst"]): r["n"] for r in metrics.coupling_matrix(c, a).collect()}
    assert len(m) == 9 and m["A", "A"] == 9 and m["C", "A"] == 0


def test_dependencies_and_averages(spark):
    d = spark.createDataFrame([("m", True, "x", "read"), ("m", True, "x", "write"), ("m", False, "y", "call"), ("m", False, "y", "call")], "k string, inside boolean, member string, mode string")
    r = metrics.dependencies(d, ["k"]).collect()[0]
    assert (r["source_deps"], r["target_deps"], r["internal_reads"], r["internal_writes"], r["external_calls"], r["external_reads"]) == (1, 1, 1, 1, 1, 0)
    assert rows(metrics.dependency_histogram(d, ["k"]), "mode", "member", "n") == [("call", "y", 2), ("read", "x", 1), ("write", "x", 1)]
    g = spark.createDataFrame([("a", 4, True), ("a", 8, False)], "g string, v int, kept boolean")
    r = metrics.group_averages(g, ["g"], ["v"], "kept").collect()[0]
    assert (r["avg_v"], r["max_v"], r["n_kept"]) == (2.0, 4, 1)
    w = spark.createDataFrame([(1, "d1", "TYPE_MISMATCH", 2, "a", "b"), (1, "d2", "VARIABLE_NAME_MISMATCH", 1, "ab", "ac"), (1, "d2", "VARIABLE_NAME_MISMATCH", 1, "ab", "ac")], "m int, difference string, kind string, weight int, left string, right string")
    r = metrics.weighted_differences(w, ["m"]).collect()[0]
    assert (r["all_weight"], r["all_plain_weight"], r["distinct_weight"], r["distinct_plain_weight"], r["edit_distance"]) == (4, 2, 3, 1, 2)


def test_topics(spark):
    w = spark.createDataFrame([("c", x) for x in ("order", "order", "order", "total", "total", "pars")], "c string, w string")
    assert metrics.modal(w, ["c"], "w").collect()[0]["terms"] == ["order"]
    tie = spark.createDataFrame([("c", "b"), ("c", "a")], "c string, w string")
    assert metrics.modal(tie, ["c"], "w").collect()[0]["terms"] == ["a", "b"]


# --- clusters

def matrix(n, **near):
    d = np.ones((n, n))
    for k, v in near.items():
        i, j = (ord(c) - 97 for c in k)
        d[i, j] = d[j, i] = v
    return d


def test_snapshots():
    assert sorted(cluster.snapshots(matrix(4, ab=0.2, cd=0.3))) == [(0, 1), (2, 3)]
    assert cluster.snapshots(matrix(4, ab=0.2, bc=0.3, ac=0.9)) == []
    assert cluster.snapshots(matrix(2, ab=0.1)) == [] and cluster.snapshots(matrix(5)) == []
    assert cluster.snapshots(matrix(5, ab=0.2)) == [(0, 1)]


def test_linked_pairs_alone():
    """Equal distances of cluster pairs in the order of a full matrix, and memory that follows the pairs."""
    d = matrix(6, bc=0.2, ac=0.2, de=0.2, cd=0.5, ef=0.9)
    assert cluster.snapshots(d) == plain_snapshots(d)
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(2, 12))
        d = np.tril(rng.integers(1, 6, (n, n)) / 5, -1)
        assert cluster.snapshots(d + d.T) == plain_snapshots(d + d.T)
    many = 300_000  # a matrix of them would take 720 GB
    k = np.arange(0, many, 2)
    assert len(cluster.linked(many, k + 1, k, np.full(len(k), 0.5))) == len(k)


def plain_snapshots(d):
    """Cluster after cluster by the whole matrix of distances."""
    clusters, seen = [(k,) for k in range(len(d))], {}
    while len(clusters) > 2:
        least = min(((min(d[x, y] for x in p for y in q), i, j) for i, p in enumerate(clusters) for j, q in enumerate(clusters) if j < i), default=(2.0, 0, 0))
        if least[0] >= 1:
            break
        _, i, j = least
        one, two = clusters[j], clusters.pop(i)
        gone = one if len(two) == 1 < len(one) else two if len(one) == 1 < len(two) else None
        clusters[j] = one + two
        seen.pop(gone, None)
        if len(clusters) > 2 or min(map(len, clusters)) > 1:
            seen.update((c, None) for c in clusters if len(c) > 1)
    return list(seen)


def test_hierarchical(spark):
    e = spark.createDataFrame([("C", x, k) for k, x in enumerate("abcd")] + [("D", "z", 0)], "class string, entity string, position int")
    d = spark.createDataFrame([("C", "a", "b", 0.2), ("C", "d", "c", 0.3)], "class string, a string, b string, dist double")
    got = {tuple(r["entities"]) for r in cluster.hierarchical(e, d).collect()}
    assert got == {("a", "b"), ("c", "d")}


def test_concepts(spark):
    c = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "b"), ("3", "c"), ("4", "c"), ("4", "d"), ("5", "e")], "candidate string, entity string")
    assert rows(cluster.concepts(c), "candidate", "concept") == [("1", "1"), ("2", "1"), ("3", "3"), ("4", "3"), ("5", "5")]
    f = c.withColumnRenamed("entity", "field")
    got = {r["candidate"]: r["additional"] for r in cluster.absorb_fields(f).collect()}
    assert got == {"1": [], "2": ["a"], "3": ["d"], "4": [], "5": []}


# --- graphs

def test_closure(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = {(r["src"], r["dst"]): r["depth"] for r in graph.closure(e).collect()}
    assert len(got) == 12 and got["a", "a"] == 3 and got["a", "d"] == 3 and ("d", "d") not in got
    seed = spark.createDataFrame([("c",)], "src string")
    assert rows(graph.closure(e, seed, 1)) == [("c", "a", 1), ("c", "d", 1)]
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    assert rows(graph.strong_components(e, nodes)) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "e")]
    assert rows(graph.components(e.select(F.col("src").alias("a"), F.col("dst").alias("b")), nodes), "node", "component") == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("e", "e")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_strong_components_equal_mutual_reach(spark, seed):
    """Random graphs with loops, lone nodes, repeated edges, a chain into a cycle, and two cycles joined one way."""
    r = random.Random(seed)
    e = [(r.randint(0, 25), r.randint(0, 25)) for _ in range(30)] * 2 + [(k, k + 1) for k in range(30, 39)] + [(39, 36), (50, 52), (52, 51), (51, 50), (51, 60), (60, 61), (61, 60), (70, 70)]
    reach = {n: {n} for n in range(80)}
    for _ in range(80):
        for s, d in e:
            reach[s] |= reach[d]
    want = [(n, min(m for m in reach[n] if n in reach[m])) for n in range(80)]
    df = spark.createDataFrame(e + [(None, 1), (1, None)], "src int, dst int")
    nodes = spark.createDataFrame([(n,) for n in range(80)], "node int")
    assert rows(graph.strong_components(df, nodes)) == want
    assert rows(graph.strong_components(df.limit(0), nodes)) == [(n, n) for n in range(80)]


def test_closure_is_idempotent(spark):
    r = random.Random(1)
    e = spark.createDataFrame([(r.randint(0, 15), r.randint(0, 15)) for _ in range(20)], "src int, dst int")
    once = graph.closure(e).select("src", "dst")
    assert rows(once) == rows(graph.closure(once).select("src", "dst"))


def test_paths_and_levels(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 4)], "src int, dst int")
    got = {tuple(r["path"]) for r in graph.paths(e, 3).collect()}
    assert got == {(1, 2), (2, 3), (3, 1), (2, 4), (1, 2, 3), (1, 2, 4), (2, 3, 1), (3, 1, 2)}
    tree = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "c")], "src string, dst string")
    assert rows(graph.leaves_by_level(tree, spark.createDataFrame([("r",)], "node string")), "leaf", "level") == [("b", 1), ("c", 2)]
    assert rows(graph.reversed_edges(tree)) == [("a", "r"), ("b", "r"), ("c", "a")]


def test_calls(spark):
    calls = spark.createDataFrame([("m", "a"), ("m", "n"), ("m", "p")], "src string, dst string")
    methods = spark.createDataFrame([("a", True, False), ("n", False, True), ("p", False, False)], "member string, is_abstract boolean, is_native boolean")
    over = spark.createDataFrame([("a", "b"), ("a", "c")], "member string, by string")
    assert rows(graph.resolved_calls(calls, methods, over)) == [("m", "b"), ("m", "c"), ("m", "p")]
    uses = spark.createDataFrame([("p", "f"), ("m", "g")], "member string, field string")
    assert rows(graph.transitive_uses(calls, uses)) == [("m", "f"), ("m", "g"), ("p", "f")]


def test_regions_and_blocks(spark):
    e = spark.createDataFrame([("g", 1, 2, "data", "x", None), ("g", 2, 3, "data", "x", 9), ("g", 2, 3, "data", "x", 1), ("g", 3, 4, "control", None, None)], "g string, src int, dst int, dep string, var string, loop_id int")
    region = spark.createDataFrame([("g", k) for k in (1, 2, 3)], "g string, node int")
    assert rows(graph.region_edges(e, region), "src", "dst", F.coalesce("loop_id", F.lit(0))) == [(1, 2, 0), (2, 3, 1)]
    n = spark.createDataFrame([("g", k, k in (3, 4)) for k in range(1, 6)], "g string, id int, leader boolean")
    assert rows(graph.blocks(n, "g", "id", "leader"), "id", "block") == [(1, 1), (2, 1), (3, 2), (4, 3), (5, 3)]
    f = spark.createDataFrame([(1, 2, False), (2, 3, False), (3, 1, True)], "src int, dst int, loopback boolean")
    reach = graph.reachable_blocks(f)
    assert rows(reach) == [(1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3)]
    dom = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (1, 3)], "src int, dst int")
    assert rows(graph.boundary_blocks(reach, dom)) == [(1, 1), (2, 1), (2, 2), (3, 1)]


# --- flow

S = flow.Statement


def edges_of(*s):
    return sorted((a, b, back, br) for a, b, back, br in flow.Flow(flow.tree(list(s))).edges)


def test_flow_graphs():
    assert edges_of(S(1, None, "simple"), S(2, None, "if"), S(3, 2, "then"), S(4, 3, "simple"), S(5, 2, "else"), S(6, 5, "return"), S(7, None, "simple")) == [(1, 2, False, None), (2, 4, False, "true"), (2, 6, False, "false"), (4, 7, False, None)]
    assert edges_of(S(1, None, "while"), S(2, 1, "if"), S(3, 2, "then"), S(4, 3, "break"), S(5, 1, "continue"), S(6, None, "simple")) == [(1, 2, False, "true"), (1, 6, False, "false"), (2, 4, False, "true"), (2, 5, False, "false"), (4, 6, False, None), (5, 1, True, None)]
    assert edges_of(S(1, None, "switch"), S(2, 1, "case"), S(3, 2, "simple"), S(4, 1, "case"), S(5, 4, "break"), S(6, 1, "default"), S(7, 6, "simple"), S(8, None, "simple")) == [(1, 3, False, "true"), (1, 5, False, "true"), (1, 7, False, "true"), (3, 5, False, None), (5, 8, False, None), (7, 8, False, None)]
    assert edges_of(S(1, None, "do"), S(2, 1, "simple"), S(3, None, "simple")) == [(1, 2, True, "true"), (1, 3, False, "false"), (2, 1, False, None)]
    assert edges_of(S(1, None, "try"), S(2, 1, "simple"), S(3, 1, "catch"), S(4, 3, "simple"), S(5, 1, "finally"), S(6, 5, "simple"), S(7, None, "simple")) == [(2, 6, False, None), (6, 7, False, None)]
    assert edges_of(S(1, None, "for", label="a"), S(2, 1, "while"), S(3, 2, "break", label="a"), S(4, None, "simple")) == [(1, 2, False, "true"), (1, 4, False, "false"), (2, 1, True, "false"), (2, 3, False, "true"), (3, 4, False, None)]


def test_dependences(spark):
    line = [S(1, None, "simple", ("x",)), S(2, None, "simple", ("y",), ("x",)), S(3, None, "simple", ("x",)), S(4, None, "simple", (), ("x",))]
    got = {(a, b, k) for a, b, k, v, _ in flow.data_dependences(line, list(flow.Flow(flow.tree(line)).edges)) if v == "x"}
    assert got == {(1, 2, "data"), (3, 4, "data"), (2, 3, "anti"), (1, 3, "output")}
    line[0] = S(1, None, "simple", ("x",), (), ("x",))
    got = {(a, b, k) for a, b, k, v, _ in flow.data_dependences(line, list(flow.Flow(flow.tree(line)).edges)) if v == "x"}
    assert (1, 3, "data") in got
    loop = [S(1, None, "simple", ("i",)), S(2, None, "while", (), ("i",)), S(3, 2, "simple", ("i",), ("i",))]
    got = set(flow.data_dependences(loop, list(flow.Flow(flow.tree(loop)).edges)))
    assert (3, 2, "data", "i", 2) in got and (3, 3, "data", "i", 2) in got and (1, 2, "data", "i", None) in got
    schema = "g string, id int, parent int, kind string, defs array<string>, uses array<string>, declares array<string>, label string"
    df = spark.createDataFrame([("m", s.id, s.parent, s.kind, list(s.defs), list(s.uses), [], None) for s in loop], schema)
    assert rows(flow.flow_edges(df), "src", "dst", "loopback") == [(1, 2, False), (2, 3, False), (3, 2, True)]
    dep = flow.dependence_edges(df)
    assert rows(dep.filter("dep = 'control'"), "src", "dst") == [(0, 1), (0, 2), (2, 3)]
    crit = spark.createDataFrame([(3,)], "node int")
    assert rows(graph.backward_slice(dep.filter("dep <> 'anti' AND dep <> 'output'").select("src", "dst"), crit)) == [(3, 0), (3, 1), (3, 2), (3, 3)]
    assert flow.alias_sets([("a", "b"), ("c", "a"), ("a", None)]) == [frozenset({"b", "c"})]


def test_slice_roles(spark):
    sl = spark.createDataFrame([("g", "x", 1, k) for k in (1, 2)], "g string, var string, block int, node int")
    e = spark.createDataFrame([("g", 1, 2, "data", "y"), ("g", 1, 3, "data", "y"), ("g", 2, 3, "data", "x")], "g string, src int, dst int, dep string, var string")
    n = spark.createDataFrame([("g", k) for k in (1, 2, 3)], "g string, node int")
    roles = flow.slice_unions(sl, e, n)
    assert rows(roles, "node", "role") == [(1, "duplicated"), (2, "removable"), (3, "remaining")]
    size = spark.createDataFrame([("g", 3)], "g string, size int")
    assert rows(flow.slice_sizes(roles), "extracted", "duplicated") == [(2, 1)]
    t = facts.Thresholds()
    assert flow.slice_passes(flow.slice_sizes(roles), size, t).count() == 1
    assert flow.slice_passes(flow.slice_sizes(roles), size, facts.Thresholds(max_duplication=0)).count() == 0


# --- joins

def test_intervals(spark):
    r = random.Random(2)
    a = [(k, r.choice("fg"), s := r.randint(0, 60), s + r.randint(0, 30)) for k in range(60)]
    df = spark.createDataFrame(a, "id int, file string, start int, end int")
    want = sorted((x[0], y[0]) for x in a for y in a if x[1] == y[1] and y[2] <= x[2] and x[3] <= y[3])
    assert rows(joins.contained(df, df, ["file"]), "i_id", "o_id") == want == rows(joins.contained(df, df, ["file"], bin_width=7), "i_id", "o_id")
    inner = {r["i_id"]: r["o_id"] for r in joins.innermost(df, df, ["file"], ["id"], bin_width=7).collect()}
    assert inner == {x[0]: min((y[3] - y[2], y[0]) for y in a if x[1] == y[1] and y[2] <= x[2] and x[3] <= y[3])[1] for x in a}


def test_divide_and_upsert(spark):
    x = spark.createDataFrame([("p", 1), ("p", 2), ("q", 1)], "g string, e int")
    assert rows(joins.divide(x, "g", "e", x.select("e"))) == [("p",)]
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    out = joins.upsert(t, ["k"], removed=t.filter("k = 1"), changed=spark.createDataFrame([(2, "B")], t.schema), added=spark.createDataFrame([(4, "d")], t.schema))
    assert rows(out) == [(2, "B"), (3, "c"), (4, "d")]
    with pytest.raises(ValueError):
        joins.require_none(t, "errors")
    assert joins.require_none(t.limit(0), "errors").count() == 0


# --- facts

MEMBERS = "class string, member string, kind string, access string, is_static boolean, is_accessor boolean"


def test_entity_sets(spark):
    m = spark.createDataFrame([("A", "A::int x", "field", "private", False, False), ("A", "A::B b", "field", "private", False, False), ("A", "A::f():void", "method", "public", False, False), ("A", "A::g():void", "method", "private", False, False), ("A", "A::s():void", "method", "private", True, False)], MEMBERS)
    a = spark.createDataFrame([("A::f():void", "A::int x"), ("A::f():void", "A::B b"), ("A::f():void", "A::g():void"), ("A::f():void", "A::f():void")], "src string, dst string")
    ref = spark.createDataFrame([("A::B b",)], "member string")
    f = {r["member"]: (r["eset"], r["full_set"]) for r in facts.method_sets(m, a, ref).collect()}
    assert f["A::f():void"] == (["A::g():void", "A::int x"], ["A::B b", "A::f():void", "A::g():void", "A::int x"]) and f["A::g():void"] == ([], ["A::g():void"])
    g = {r["member"]: (r["eset"], r["full_set"]) for r in facts.attribute_sets(m, a, ref).collect()}
    assert g["A::int x"] == (["A::f():void"], ["A::f():void", "A::int x"]) and g["A::B b"] == ([], ["A::B b", "A::f():void"])
    assert "A::B b" not in facts.class_sets(m, ref).collect()[0]["eset"]
    assert facts.system(m).count() == 4 and facts.system(m, with_static=True).count() == 5
    acc = facts.access_map(facts.method_sets(m, a, ref).select(F.col("member").alias("entity"), "eset"))
    assert rows(facts.annotation(acc)) == [("A::f():void", "A: A::g():void, A::int x")]


def test_access_map_takes_in_superclass(spark):
    s = spark.createDataFrame([("e", ["Sub::a", "Base::b", "Other::c"])], "entity string, eset array<string>")
    up = spark.createDataFrame([("Sub", "Base")], "class string, superclass string")
    assert rows(facts.access_map(s, up), "owner", "members") == [("Base", ["Base::b"]), ("Other", ["Other::c"]), ("Sub", ["Base::b", "Sub::a"])]


def test_fact_predicates(spark):
    c = spark.createDataFrame([("A", "class", []), ("E", "enum", []), ("I", "interface", []), ("G", "class", ["generated by JFlex"])], "class string, kind string, comments array<string>")
    assert rows(facts.eligible_classes(c), "class") == [("A",)]
    x = spark.range(1).select(facts.is_getter(F.lit("return"), F.array(), F.lit(1), F.lit(0), F.lit(0), F.lit(0)), facts.is_setter(F.lit("assignment"), F.array(F.lit("p")), F.lit(0), F.lit(1), F.lit(0)), facts.is_collection_adder(F.array(F.lit("p")), F.lit(1), F.lit(1), F.lit("add"), F.lit("java.util.List<x.Y>"), F.lit(0), F.lit(1)), facts.is_delegate(F.lit("return"), F.lit(1), F.lit("field")), facts.is_test(F.lit("junit.framework.TestCase"), F.array().cast("array<string>"))).collect()[0]
    assert list(x) == [True] * 5
    fields = spark.createDataFrame([("A", "A::x", "java.util.List<E>"), ("A", "A::y", "int"), ("A", "A::z", "G")], "class string, member string, type string")
    assert rows(facts.associations(fields, c), "to_class", "is_container") == [("E", True), ("G", False)]
    m = spark.createDataFrame([("A", "A::h", "method", "private", False, False), ("A", "A::k", "method", "private", False, False), ("A", "A::f", "method", "public", False, False)], MEMBERS)
    a = spark.createDataFrame([("A::f", "A::h", "A", "A", "call"), ("A::f", "A::k", "A", "A", "call"), ("A::k", "B::x", "A", "B", "read"), ("B::q", "A::f", "B", "A", "call")], "src string, dst string, src_class string, dst_class string, mode string")
    assert rows(facts.private_helpers(a, m)) == [("A::f", "A::h")]
    assert rows(facts.used_outside(a, m), "member") == [("A::f",)]
    v = spark.range(1).select(facts.violations({"one": F.lit(True), "two": F.lit(False)}), facts.passes(())).collect()[0]
    assert list(v) == [["one"], True]
    t = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "type string, parent string")
    assert rows(facts.flatten_nested(t)) == [("a", ["a"]), ("b", ["a", "b"]), ("c", ["a", "b", "c"])]


# --- candidates

def accesses(spark, spec):
    out = [(e, s, o, f"{o}{k}") for e, s, uses in spec for o, n in uses.items() for k in range(n)]
    return spark.createDataFrame(out, "entity string, source string, owner string, member string")


def test_move_methods(spark):
    a = accesses(spark, [("m1", "S", {"S": 1, "T": 3}), ("m2", "S", {"S": 3, "T": 3}), ("m3", "S", {"S": 2, "T": 2, "U": 4}), ("m4", "S", {"T": 2, "U": 2}), ("m5", "S", {"S": 5, "T": 2})])
    assert rows(candidates.move_methods(a), "entity", "target", "source_deps", "target_deps") == [("m1", "T", 1, 3), ("m3", "U", 2, 4), ("m4", "T", 0, 2), ("m4", "U", 0, 2)]
    ok = spark.createDataFrame([("m3", "T")], "entity string, target string")
    assert rows(candidates.move_methods(a, applicable=ok)) == []
    up = spark.createDataFrame([("U", "T")], "class string, ancestor string")
    assert ("m4", "T") not in rows(candidates.move_methods(a, ancestors=up), "entity", "target")
    bound = spark.createDataFrame([("S", "m1", "Z", 0, 1)], "source string, entity string, target string, source_deps long, target_deps long")
    assert ("m1", "Z") in rows(candidates.move_methods(a, bound=bound), "entity", "target") and ("m1", "T") not in rows(candidates.move_methods(a, bound=bound), "entity", "target")
    c = spark.createDataFrame([("s", "x", "B", 0, 3), ("s", "y", "C", 0, 5), ("s", "z", "A", 1, 9)], "source string, entity string, target string, source_deps int, target_deps int")
    assert [r["target"] for r in candidates.ranked(c).orderBy("rank").collect()] == ["C", "B", "A"]


def test_extract_classes(spark):
    e = spark.createDataFrame([("C", "f1", 0, "field"), ("C", "f2", 1, "field"), ("C", "g1", 2, "field"), ("C", "m1", 3, "method"), ("C", "m2", 4, "method"), ("C", "n1", 5, "method")], "class string, entity string, position int, kind string")
    acc = [("m1", "f1"), ("m1", "f2"), ("m2", "f1"), ("m2", "f2"), ("n1", "g1")]
    full = {x: {x} for x in ("f1", "f2", "g1", "m1", "m2", "n1")}
    for m, f in acc:
        full[m].add(f)
        full[f].add(m)
    s = spark.createDataFrame([("C", k, sorted(v)) for k, v in full.items()], "class string, entity string, full_set array<string>")
    names_ = spark.createDataFrame([("f1", "orderTotal"), ("f2", "order"), ("m1", "parseOrder"), ("m2", "printTotal"), ("g1", "x"), ("n1", "y")], "entity string, name string")
    got = candidates.extract_classes(e, s, spark.createDataFrame(acc, "src string, dst string"), names_).collect()
    assert any(r["entities"] == ["f1", "f2", "m1", "m2"] and r["topics"] == ["order"] and (r["source_deps"], r["extracted_deps"]) == (0, 2) for r in got)


def test_groups_and_ranks(spark):
    x = spark.createDataFrame([("g", "A", 1, 2.0), ("g", "A", 2, 4.0), ("g", "B", 3, 6.0), ("h", "A", 4, 1.0)], "group string, class string, candidate int, statements double")
    g = candidates.type_check_groups(x)
    assert rows(g) == [("g", 3, 1.5, 4.0), ("h", 1, 1.0, 1.0)]
    assert [r["group"] for r in candidates.rank_type_checks(g).orderBy("rank").collect()] == ["g", "h"]
    s = spark.createDataFrame([("a", 0.0, 0.0, 5, 2.0), ("b", 0.0, 0.0, 9, 1.0), ("c", 0.5, 1.0, 20, 9.0), ("d", 0.5, 0.5, 1, 1.0)], "name string, avg_ratio double, avg_duplicated double, max_extracted int, avg_extracted double")
    assert [r["name"] for r in candidates.rank_slices(s).orderBy("rank").collect()] == ["b", "a", "d", "c"]


# --- clones

def test_sub_groups(spark):
    i = spark.createDataFrame([(1, 1, "f1", 10, 50), (1, 2, "f2", 5, 60), (2, 1, "f1", 12, 40), (2, 2, "f2", 5, 60), (3, 1, "f1", 12, 40), (3, 2, "f2", 5, 60)], "group_id int, instance_id int, file string, start int, end int")
    assert rows(clones.sub_groups(i), "group_id", "parent", "first_parent") == [(2, 1, True)]
    assert rows(clones.relative_location(spark.createDataFrame([(1, "f", "m"), (1, "f", "m"), (2, "f", "m"), (2, "f", "n"), (3, "f", "m"), (3, "g", "m")], "group_id int, file string, method string"))) == [(1, "same method"), (2, "same file"), (3, "different files")]


def test_similar_sets(spark):
    r = random.Random(3)
    s = {k: {r.randint(0, 12) for _ in range(r.randint(1, 9))} for k in range(60)}
    df = spark.createDataFrame([(k, e) for k, v in s.items() for e in v], "k int, e int")
    want = sorted((a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]))
    assert rows(clones.similar_sets(df, "k", "e", 0.8), "a", "b") == want


def test_types_and_mappings(spark):
    t = spark.range(1).select(clones.clone_type(F.lit(0), F.lit(0), F.lit(0)), clones.clone_type(F.lit(0), F.lit(2), F.lit(0)), clones.clone_type(F.lit(1), F.lit(0), F.lit(0)), clones.clone_type(F.lit(None), F.lit(0), F.lit(0))).collect()[0]
    assert list(t) == ["type 1", "type 2", "type 3", "unknown"]
    one = [(1, 2, "data"), (2, 3, "data"), (1, 3, "control")]
    assert clones.map_graphs(one, [(x + 10, z + 10, k) for x, z, k in one], {1: "a", 2: "b", 3: "c"}, {11: "a", 12: "b", 13: "c"}) == ([(1, 11), (2, 12), (3, 13)], True)
    assert len(clones.map_graphs(one, [(11, 12, "data")], {1: "a", 2: "b", 3: "c"}, {11: "a", 12: "b"})[0]) == 2
    assert clones.map_graphs(one, one, {1: "a", 2: "a", 3: "a"}, {1: "a", 2: "a", 3: "a"}, most=1)[1] is False
    node, edge = "array<struct<id:int,kind:string>>", "array<struct<src:int,dst:int,dep:string>>"
    df = spark.createDataFrame([(7, [(1, "a"), (2, "b")], [(1, 2, "data")], [(5, "a"), (6, "b")], [(5, 6, "data")])], f"pair long, nodes1 {node}, edges1 {edge}, nodes2 {node}, edges2 {edge}")
    got = clones.mapped_pairs(df).collect()[0]
    assert [(m["a"], m["b"]) for m in got["mapping"]] == [(1, 5), (2, 6)] and got["complete"]
    sol = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b", "c"]), (3, ["d"]), (4, ["d"])], "k int, e array<string>")
    assert rows(clones.without_subsumed(sol, "k", "e"), "k") == [(2,), (3,)]
    st = spark.createDataFrame([("p", 1, 3, 1, 1, 1, 0, 0), ("p", 2, 4, 9, 9, 9, 0, 0), ("p", 3, 4, 2, 9, 9, 5, 5)], "pair string, state int, size int, distinct_plain_weight int, all_plain_weight int, all_weight int, id_shift int, edit_distance int")
    assert rows(clones.best_mapping(st, ["pair"], "state"), "state") == [(3,)]
    anc = spark.createDataFrame([("x", "Base", 1), ("y", "Base", 2), ("x", "Object", 2), ("y", "Object", 3)], "type string, ancestor string, depth int")
    assert rows(clones.common_supertype(spark.createDataFrame([("x", "y")], "a string, b string"), anc)) == [("x", "y", "Base")]


# --- versions

def test_evolution(spark):
    v = spark.createDataFrame([("m", 1, ["a", "b", "c"]), ("m", 2, ["a", "x", "c", "d"]), ("m", 3, None)], "entity string, version int, tokens array<string>")
    got = [(r["distance"], r["similarity"], r["change"]) for r in evolution.token_evolution(v, ["entity"], ["version"], "tokens").orderBy("version").collect()]
    assert got == [(None, None, None), (2, 0.5, 0.5), (None, None, None)]
    x = spark.range(1).select(evolution.envy_evolution(F.lit(2), F.lit(4), F.lit(8), F.lit(4)), evolution.group_evolution(F.lit(0), F.lit(0)), evolution.group_evolution(F.lit(1), F.lit(4))).collect()[0]
    assert list(x) == [0.75, None, 0.75]
    p = spark.createDataFrame([("tool-1.10",), ("tool-1.9",), ("plain",)], "name string")
    assert [r["name"] for r in evolution.discover(p, "name").orderBy("family", "version_key").collect()] == ["tool-1.9", "tool-1.10"]


# --- smaller operators

def test_more_facts(spark):
    f = spark.createDataFrame([("A", "A::items"), ("A", "A::n")], "class string, member string")
    add = spark.createDataFrame([("A", "A::items", "B"), ("A", "A::n", "int")], "class string, field string, element_type string")
    c = spark.createDataFrame([("A",), ("B",)], "class string")
    assert rows(facts.adder_associations(f, add, c), "from_class", "to_class", "field") == [("A", "B", "A::items")]
    k = spark.createDataFrame([("RED_CAR",), ("BUS",)], "constant string")
    assert rows(facts.constants_of_subclasses(k, spark.createDataFrame([("p.RedCar",), ("p.Van",)], "class string"))) == [("RED_CAR", "p.RedCar")]
    a = spark.createDataFrame([("X", "Base"), ("Base", "Base")], "src_class string, dst_class string")
    assert rows(facts.friends(a, spark.createDataFrame([("Sub", "Base", 1)], "type string, ancestor string, depth int"))) == [("Base", "X"), ("Sub", "X")]
    com = spark.createDataFrame([(1, "d/A.java", 5, 6), (2, "d/A.java", 0, 1), (3, "d/Z.java", 0, 1)], "comment int, file string, start int, end int")
    ty = spark.createDataFrame([("p.A", "d/A.java", 3, 90), ("p.In", "d/A.java", 4, 8)], "type string, file string, start int, end int")
    assert rows(facts.comments_of_types(com, ty)) == [(1, "p.A"), (1, "p.In"), (2, "p.A")]
    acc = spark.createDataFrame([("m", "A", "x"), ("m", "A", "y"), ("m", "B", "z"), ("m", "C", "w"), ("m", "C", "w")], "entity string, owner string, member string")
    assert rows(metrics.access_buckets(acc), "entity", "n", "owners") == [("m", 1, ["B", "C"]), ("m", 2, ["A"])]


def test_more_graphs(spark):
    ctl = spark.createDataFrame([(0, 1), (0, 2), (2, 3)], "src int, dst int")
    assert rows(graph.dominated(ctl).filter("src = 2")) == [(2, 2), (2, 3)]
    reach = spark.createDataFrame([(1, 1), (1, 2)], "src int, dst int")
    bl = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "block int, node int")
    assert rows(graph.block_region(bl, reach, spark.createDataFrame([(1,)], "boundary int"))) == [(1, 10), (1, 20)]
    asc = spark.createDataFrame([("A", "B", False), ("B", "C", True)], "from_class string, to_class string, is_container boolean")
    assert {(tuple(r["path"]), r["container"]) for r in graph.container_paths(asc, 3).collect()} == {(("A", "B"), False), (("B", "C"), True), (("A", "B", "C"), True)}
    ext = spark.createDataFrame([("Mid", "Top"), ("Leaf", "Mid")], "sub string, super string")
    assert rows(graph.sub_types(ext, spark.createDataFrame([("Mid",)], "type string"))) == [("Mid", "Leaf"), ("Top", "Leaf")]
    st = spark.createDataFrame([("g", 1, ["x"], ["x"]), ("g", 2, ["x"], None), ("g", 3, ["x", "y"], [])], "g string, id int, defs array<string>, declares array<string>")
    assert rows(flow.slice_criteria(st), "var", "node") == [("x", 2), ("x", 3), ("y", 3)]
    b = spark.createDataFrame([("g", "x", 2, 1), ("g", "x", 3, 1), ("g", "x", 3, 4), ("g", "y", 3, 4)], "g string, var string, node int, block int")
    assert rows(flow.common_boundaries(b), "var", "block") == [("x", 1), ("y", 4)]


def test_generated_marks(spark):
    marks = ["Generated By:JavaCC: Do not edit", "Generated By:JJTree", "Generated from X.g by ANTLR", "generated by JFlex 1", "generated by CUP v0", "created by jay 0.7"]
    other = ["uses JavaCC", "generated by ANTLR", "Generated from X.g", "jay/yacc"]
    df = spark.createDataFrame([(c, [c]) for c in marks + other], "c string, comments array<string>")
    assert {r["c"] for r in df.filter(names.is_generated(F.col("comments"))).collect()} == set(marks)
    assert "java.util.Stack" not in facts.COLLECTIONS


def test_without_subsumed_by_hand(spark):
    """Against all pairs, with wide and empty sets, ties and repeated elements."""
    import random

    r = random.Random(3)
    for wide in (64, 3):
        solutions = {k: [r.randint(0, 9) for _ in range(r.choice([0, 1, 1, 2, 2, 3, 4, 7]))] for k in range(60)}
        sets_ = {k: set(v) for k, v in solutions.items()}
        want = {k for k, v in sets_.items() if not any(j != k and (v < w or (v == w and j < k)) for j, w in sets_.items())}
        df = spark.createDataFrame(list(solutions.items()), "k long, e array<int>")
        assert {x["k"] for x in clones.without_subsumed(df, "k", "e", wide).collect()} == want


def test_slice_groups(spark):
    """The two slices of the survey's hand-computed case, and a group whose slices share nothing."""
    rows = [("g", 1, e) for e in (1, 2, 3)] + [("g", 2, e) for e in (2, 3, 4, 5)] + [("h", 1, 1), ("h", 2, 2), ("g", 1, 1)]
    got = {x["group"]: x for x in metrics.slice_group_measures(spark.createDataFrame(rows, "group string, slice int, element int")).collect()}
    assert (got["g"]["slices"], got["g"]["total"], got["g"]["common"]) == (2, 7, 2) and abs(got["g"]["overlap"] - (2 / 3 + 2 / 4) / 2) < 1e-9
    assert got["h"]["common"] == 0 and got["h"]["overlap"] == 0


def test_refactoring_outcomes(spark):
    base = {"class_a": "A", "class_b": "B", "super_a": "S", "super_b": "S", "supertype": "S", "supertype_kind": "class", "is_internal": True, "is_tagging": False, "subtypes": ["A", "B", "C"], "is_leaf": True, "uses_members": True, "signatures_match": True, "is_static": False, "is_mapped": True, "is_anonymous": False}
    o = "java.lang.Object"
    roots, face = {"super_a": o, "super_b": o}, {"supertype": "I", "supertype_kind": "interface"}
    cases = [
        ({"class_b": "A"}, 0), ({"uses_members": False}, 1), ({"subtypes": ["A", "B"]}, 1), ({"subtypes": ["A", "B"], "is_leaf": False}, 2), ({"class_a": "S", "super_a": "R"}, 1), ({"super_a": "M"}, 1), ({}, 2),
        ({**roots, **face}, 3), ({"is_internal": False}, 4), ({**roots, **face, "is_internal": False}, 5), ({**roots, "supertype": o, "is_internal": False}, 6), ({**face, "uses_members": False}, 7),
        ({"is_internal": False, "uses_members": False, "is_static": True}, 7), ({"is_internal": False, "super_b": "M"}, 8), (face, 8), ({**roots, **face, "is_tagging": True, "signatures_match": False}, 8),
        ({**roots, **face, "signatures_match": False}, 3), ({"supertype": None}, 8), ({"is_mapped": False, "class_b": "A"}, 8), ({"is_anonymous": True}, 8), ({"supertype": None, "class_b": "A"}, 0),
    ]
    schema = "i int, class_a string, class_b string, super_a string, super_b string, supertype string, supertype_kind string, is_internal boolean, is_tagging boolean, subtypes array<string>, is_leaf boolean, uses_members boolean, signatures_match boolean, is_static boolean, is_mapped boolean, is_anonymous boolean"
    df = spark.createDataFrame([(i, *{**base, **c}.values()) for i, (c, _) in enumerate(cases)], schema)
    got = {r["i"]: r["outcome"] for r in clones.refactoring_type(df).collect()}
    assert [got[i] for i in range(len(cases))] == [clones.OUTCOMES[k] for _, k in cases]


def test_dependencies_by_bits(spark):
    """Counts of distinct members without a row for each count, with members and places that aren't known."""
    x = spark.createDataFrame([("k", True, "a", "call"), ("k", True, "a", "call"), ("k", True, "a", "read"), ("k", False, "a", "read"), ("k", False, "b", "write"), ("k", True, None, "read"), ("k", None, "c", "call"), ("k", True, "d", "other")], "k string, inside boolean, member string, mode string")
    out = metrics.dependencies(x, ["k"])
    want = {"k": "k", "internal_calls": 1, "external_calls": 0, "internal_reads": 2, "external_reads": 1, "internal_writes": 0, "external_writes": 1, "source_deps": 2, "target_deps": 2}
    assert out.first().asDict() == want and "Expand" not in out._jdf.queryExecution().executedPlan().toString()


def test_equal_graphs_are_searched_once(spark):
    graph = "array(named_struct('id', 1, 'kind', 'A'), named_struct('id', 2, 'kind', 'B')) AS nodes{0}, array(named_struct('src', 1, 'dst', 2, 'dep', 'd')) AS edges{0}"
    pairs = spark.sql(f"SELECT id AS pair, {graph.format(1)}, {graph.format(2)} FROM range(50)")
    for parts in (1, 7):
        out = clones.mapped_pairs(pairs, parts=parts)
        got = sorted((r["pair"], [(m["a"], m["b"]) for m in r["mapping"]], r["complete"]) for r in out.collect())
        assert got == [(k, [(1, 1), (2, 2)], True) for k in range(50)]
    plan = clones.mapped_pairs(pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Aggregate")  # the search reads groups of equal graphs
