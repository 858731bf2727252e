"""Object-state slices against plain sets, on cases made by hand and at random."""

import random

import pytest

from factloom.operators import slices

NODES = "method string, node int, kind string, loop int, uses array<string>, declares array<string>, renews array<string>, closes array<string>, creates array<string>, touches array<string>, defines array<struct<name:string,is_field:boolean,composite:boolean>>"
EDGES = "method string, src int, dst int, dep string, variable string"
STATE, VARIABLES, REGION = "method string, node int, object string", "method string, variable string, is_field boolean, is_parameter boolean", "method string, block int, node int"


def reach(starts, edges, inside):
    found, todo = set(), list(starts)
    while todo:
        n = todo.pop()
        if n not in found:
            found.add(n)
            todo += [s for s, d, dep, _ in edges if d == n and dep in ("control", "data") and s in inside and n in inside]
    return found


def plain(obj, inside, state, uses, throws, declares, fields, edges, nodes):
    """(slice, removable) by the definition, one set after another."""
    criteria = {n for n, o in state if o == obj}
    body = reach(criteria, edges, inside)
    for other in {u for n in body for u in uses.get(n, ())} - {obj}:
        body |= reach({n for n, o in state if o == other and n in inside}, edges, inside)
    ups = {t: reach({t}, [e for e in edges if e[2] == "control"], set(nodes) | {0}) - {t} for t in throws}
    here = [t for t in throws if t in inside]
    body |= {n for t in here if ups[t] & body for n in reach({t}, edges, inside)}
    rest = set(nodes) - body
    needed = {s for s, d, dep, v in edges if s in body and d in rest and (dep == "control" or (dep == "data" and v != obj and v not in fields))}
    kept = reach(needed, edges, inside)
    kept |= {n for t in here if ups[t] & (rest | kept) - {0} for n in reach({t}, edges, inside)}
    first = min((n for n in body if obj in declares.get(n, ())), default=None)
    return body, (body - kept) | ({first} - {None})


def case(seed):
    r = random.Random(seed)
    n, objects = r.randint(4, 12), ["a", "b", "f"]
    nodes = list(range(1, n + 1))
    kinds = {k: r.choice(["other", "other", "throw", "try"]) for k in nodes}
    edges = [(r.choice([0, *range(1, k)]), k, "control", None) for k in nodes]
    edges += [(s, d, dep, r.choice(objects)) for dep in ("data", "anti") for _ in range(n) for s, d in [sorted(r.sample(nodes, 2))]]
    state = [(r.choice(nodes), r.choice(objects)) for _ in range(4)]
    uses = {k: r.sample(objects, r.randint(0, 2)) for k in nodes}
    declares = {k: ["a"] for k in r.sample(nodes, 2) if kinds[k] != "try"}
    return nodes, kinds, edges, state, uses, declares


def test_slices_equal_plain_sets(spark):
    cases = {f"m{i}": case(i) for i in range(40)}
    rows = {"nodes": [], "edges": [], "state": [], "region": [], "variables": [], "bounds": []}
    for m, (nodes, kinds, edges, state, uses, declares) in cases.items():
        rows["nodes"] += [(m, k, kinds[k], None, uses[k], declares.get(k), None, None, None, None, None) for k in nodes]
        rows["edges"] += [(m, *e) for e in edges]
        rows["state"] += [(m, *s) for s in state] * 2
        rows["region"] += [(m, b, k) for b in (1, 3) for k in nodes if k >= b]
        rows["bounds"] += [(m, k, b) for b in (1, 3) for k in nodes if k >= b]
        rows["variables"] += [(m, "f", True, False), (m, "a", False, False)]
    df = lambda k, s: spark.createDataFrame(rows[k], s)
    state = df("state", STATE)
    heads = slices.object_heads(state, df("bounds", "method string, node int, block int"))
    got = {}
    for x in slices.object_slices(heads, state, df("nodes", NODES), df("variables", VARIABLES), df("edges", EDGES), df("region", REGION)).collect():
        assert x["removable"] != x["indispensable"]
        a, b = got.setdefault(tuple(x["slice"]), (set(), set()))
        a.add(x["node"])
        if x["removable"]:
            b.add(x["node"])
    want = {}
    for m, (nodes, kinds, edges, state, uses, declares) in cases.items():
        throws = [k for k in nodes if kinds[k] == "throw"]
        for o in {o for _, o in state}:
            for b in (1, 3):
                if min(k for k, x in state if x == o) >= b:
                    want[m, o, b] = plain(o, {k for k in nodes if k >= b}, state, uses, throws, declares, {"f"}, edges, nodes)
    assert got == want
    assert any(r != s for s, r in want.values()) and len(want) > 100


@pytest.fixture(scope="module")
def empty(spark):
    df = lambda s: spark.createDataFrame([], s)
    return df(STATE), df(NODES), df(VARIABLES), df(EDGES), df(REGION)


def test_empty_tables(spark, empty):
    state, nodes, variables, edges, region = empty
    heads = slices.object_heads(state, spark.createDataFrame([], "method string, node int, block int"))
    members = slices.object_slices(heads, state, nodes, variables, edges, region)
    assert members.count() == 0 and slices.passed_parameters(heads, members, edges).count() == 0
    sizes, returned = spark.createDataFrame([], "method string, method_size int"), spark.createDataFrame([], "method string, variable string")
    assert slices.object_slice_rules(heads, members, sizes, nodes, edges, region, returned).count() == 0


def test_no_common_block_no_slice(spark):
    state = spark.createDataFrame([("m", 1, "a"), ("m", 5, "a"), ("m", 5, "b"), ("m", 9, "c")], STATE)
    bounds = spark.createDataFrame([("m", 1, 1), ("m", 5, 2)], "method string, node int, block int")
    assert sorted(tuple(r["slice"]) for r in slices.object_heads(state, bounds).collect()) == [("m", "b", 2)]


def test_rules_of_sizes(spark, empty):
    """One node; two with the declaration; all but the return; a passed variable."""
    nodes = [("m", k, "exit" if k == 4 else "other", None, [], ["a"] if k == 1 else [], [], [], [], [], None) for k in (1, 2, 3, 4)] + [("n", k, "other", None, [], [], [], [], [], [], None) for k in (1, 2, 3)]
    nodes += [("o", k, "other", None, [], ["a"] if k == 1 else [], [], [], [], [], None) for k in (1, 2, 3, 4)]
    edges = [("m", 1, 2, "data", "a"), ("m", 2, 3, "data", "a"), ("n", 1, 2, "anti", "z"), ("o", 1, 2, "data", "a"), ("o", 3, 2, "data", "z")]
    state = spark.createDataFrame([("m", 3, "a"), ("n", 2, "a"), ("o", 2, "a")], STATE)
    region = spark.createDataFrame([("m", 1, k) for k in (1, 2, 3, 4)] + [("n", 1, k) for k in (1, 2, 3)] + [("o", 1, k) for k in (1, 2)], REGION)
    heads = slices.object_heads(state, region.select("method", "node", "block"))
    nodes, edges = spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)
    members = slices.object_slices(heads, state, nodes, empty[2], edges, region)
    assert {(r["slice"]["method"], r["variable"]) for r in slices.passed_parameters(heads, members, edges).collect()} == {("o", "z")}
    sizes = nodes.groupBy("method").count().withColumnRenamed("count", "method_size")
    out = {r["method"]: {k for k in slices.OBJECT_SLICE if r[k]} for r in slices.object_slice_rules(heads, members, sizes, nodes, edges, region, spark.createDataFrame([], "method string, variable string")).collect()}
    assert out == {"m": {"whole_body"}, "n": {"minimum_size", "anti_dependence"}, "o": {"minimum_size"}}
