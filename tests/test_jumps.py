"""Control dependences by post-dominance: nested switch, labelled break, throw in try, and slices that change with them."""

import random

from factloom.operators import flow, graph

S = flow.Statement


def deps(rows):
    return {(s, d) for s, d, *_ in flow.jump_dependences(rows)}


def test_labelled_break():
    """1 while outer { 2 while { 3 if {4 then: 5 break outer} 6 } 7 } 8: 6, 2 and 7 run again only if 3 doesn't leave."""
    rows = [S(1, None, "while", label="outer"), S(2, 1, "while"), S(3, 2, "if"), S(4, 3, "then"), S(5, 4, "break", label="outer"), S(6, 2, "simple"), S(7, 1, "simple"), S(8, None, "simple")]
    got = deps(rows)
    assert {(3, 5), (3, 6), (3, 2), (2, 7), (2, 3), (1, 2), (0, 1), (0, 8)} <= got
    assert (3, 8) not in got and (0, 6) not in got and (5, 6) not in got


def test_nested_switch_falls_through():
    """1 switch { case: 3; case: 5 switch { case: 7 break; case: 9 } 10 break; default: 12 } 13."""
    rows = [
        S(1, None, "switch"), S(2, 1, "case"), S(3, 2, "simple"), S(4, 1, "case"), S(5, 4, "switch"), S(6, 5, "case"), S(7, 6, "break"), S(8, 5, "case"), S(9, 8, "simple"),
        S(10, 4, "break"), S(11, 1, "default"), S(12, 11, "simple"), S(13, None, "simple"),
    ]
    got = deps(rows)
    # 3 falls into 5, so both hang on 1; 7 and 9 hang on 5; what follows the inner switch hangs on 1 again.
    assert got == {(0, 1), (1, 3), (1, 5), (5, 7), (5, 9), (1, 10), (1, 12), (0, 13)}


def test_throw_in_try():
    """1 try { 2 if { 3 then: 4 throw } 5 } 6 catch { 7 } 8: 5 runs if nothing is thrown, 7 if it is; 8 always."""
    rows = [S(1, None, "try"), S(2, 1, "if"), S(3, 2, "then"), S(4, 3, "throw"), S(5, 1, "simple"), S(6, 1, "catch"), S(7, 6, "simple"), S(8, None, "simple")]
    assert deps(rows) == {(0, 2), (2, 4), (2, 5), (2, 7), (0, 8)}
    # Without a try the throw leaves: 5 and 8 hang on 2.
    rows = [S(2, None, "if"), S(3, 2, "then"), S(4, 3, "throw"), S(5, None, "simple"), S(8, None, "simple")]
    assert deps(rows) == {(0, 2), (2, 4), (2, 5), (2, 8)}
    assert flow.jump_dependences([]) == [] and deps([S(1, None, "while"), S(2, 1, "simple")]) == {(0, 1), (1, 1), (1, 2)}


def by_walks(edges):
    """(src, dst): some edge of src makes dst sure to run before the exit, while src itself doesn't, by removing dst."""
    follow = {flow.ENTRY: {flow.EXIT}}
    for s, d, _ in edges:
        follow.setdefault(s, set()).add(d)

    def avoids(start, x):
        seen, todo = set(), [start]
        while todo:
            n = todo.pop()
            if n == x or n in seen:
                continue
            if n == flow.EXIT:
                return True
            seen.add(n)
            todo.extend(follow.get(n, ()))
        return False

    nodes = {n for e in edges for n in e[:2]} - {flow.EXIT}
    return {(s, x, b) for s, d, b in edges for x in nodes if not avoids(d, x) and (x == s or avoids(s, x))}


def test_random_graphs():
    r = random.Random(8)
    for _ in range(200):
        n = r.randint(1, 7)
        edges = [(0, 1, None), *((k, r.choice([k + 1 if k < n else flow.EXIT, r.randint(1, n)]), r.choice("tf")) for k in range(1, n + 1) for _ in range(2)), *((k, k + 1 if k < n else flow.EXIT, None) for k in range(1, n + 1))]
        assert flow.controlled(edges) == by_walks(edges)


def test_slices_change(spark):
    """A slice of the statement after a guarded return takes in the guard only if jumps count."""
    rows = [("m", 1, None, "simple", ["x"], [], [], None), ("m", 2, None, "if", [], ["x"], [], None), ("m", 3, 2, "then", [], [], [], None), ("m", 4, 3, "return", [], [], [], None), ("m", 5, None, "simple", ["y"], [], [], None)]
    df = spark.createDataFrame(rows, "g string, id int, parent int, kind string, defs array<string>, uses array<string>, declares array<string>, label string")
    sliced = lambda jumps: {r["node"] for r in graph.backward_slice(flow.dependence_edges(df, jumps).select("src", "dst"), spark.createDataFrame([(5,)], "node int")).collect()}
    assert sliced(False) == {0, 5} and sliced(True) == {0, 1, 2, 5}
