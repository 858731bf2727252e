"""Expressions, renamings, movable statements, aliases and side effects: hand-made cases and brute force."""

import random
from collections import Counter, defaultdict

import pytest

from factloom.operators import effects, matching

NODES = "e string, node long, parent long, position long, kind string, value string, type string, super string"


def differences(spark, rows):
    df = matching.match_expressions(spark.createDataFrame([(1, "a", "b")], "pair long, e1 string, e2 string"), spark.createDataFrame(rows, NODES))
    found = df.collect()
    ok = matching.parameterizable(spark.createDataFrame([(1, "a", "b")], "pair long, e1 string, e2 string"), df).first()
    return Counter((r["kind"], r["weight"], r["left"], r["right"]) for r in found), (ok["matches"], ok["parameterizable"])


def expression(e, tree, rows=None, parent=None, position=None):
    """tree: (kind, value, type, super, {position: child})."""
    rows = [] if rows is None else rows
    node = len(rows) + 1
    kind, value, kind_of, above, kids = tree
    rows.append((e, node, parent, position, kind, value, kind_of, above))
    for at, child in kids.items():
        expression(e, child, rows, node, at)
    return rows


NAME = lambda v, t="int", s=None: ("name", v, t, s, {})
CASES = [
    # The same but for a name and a literal.
    (("infix", "+", "int", None, {0: NAME("x"), 1: ("literal", "1", "int", None, {})}), ("infix", "+", "int", None, {0: NAME("y"), 1: ("literal", "2", "int", None, {})}),
     {("VARIABLE_NAME_MISMATCH", 1, "x", "y"): 1, ("LITERAL_VALUE_MISMATCH", 1, "1", "2"): 1}, (True, True)),
    # A name against a call of the same type weighs as the call's nodes; what is below isn't compared.
    (("infix", "+", "int", None, {0: NAME("x"), 1: NAME("z")}), ("infix", "+", "int", None, {0: ("call", "f", "int", None, {0: NAME("o", "T"), 1: NAME("a")}), 1: NAME("z")}),
     {("TYPE_COMPATIBLE_REPLACEMENT", 3, "x", "f"): 1}, (True, True)),
    # Types that share a supertype; types that share none.
    (NAME("x", "Circle", "Shape"), NAME("x", "Square", "Shape"), {("SUBCLASS_TYPE_MISMATCH", 1, "x", "x"): 1}, (True, True)),
    (NAME("x", "int"), ("literal", "s", "String", None, {}), {("AST_TYPE_MISMATCH", 1, "x", "s"): 1}, (False, False)),
    # Types of variables alone can be taken up.
    (NAME("x", "int"), NAME("y", "String"), {("VARIABLE_TYPE_MISMATCH", 1, "x", "y"): 1, ("VARIABLE_NAME_MISMATCH", 1, "x", "y"): 1}, (False, True)),
    # Another number of arguments: arguments aren't compared, receivers are; without a receiver and with another name it's lost.
    (("call", "f", "int", None, {0: NAME("o"), 1: NAME("a")}), ("call", "f", "int", None, {0: NAME("q"), 1: NAME("b"), 2: NAME("c")}),
     {("ARGUMENT_NUMBER_MISMATCH", 1, "f", "f"): 1, ("VARIABLE_NAME_MISMATCH", 1, "o", "q"): 1}, (True, True)),
    (("call", "f", "int", None, {0: NAME("o"), 1: NAME("a")}), ("call", "g", "int", None, {1: NAME("a"), 2: NAME("c")}),
     {("ARGUMENT_NUMBER_MISMATCH", 1, "f", "g"): 1, ("METHOD_INVOCATION_NAME_MISMATCH", 1, "f", "g"): 1, ("MISSING_METHOD_INVOCATION_EXPRESSION", 1, "f", "g"): 1}, (True, False)),
    # Operators, further operands, dimensions.
    (("infix", "+", "int", None, {0: NAME("a"), 1: NAME("b")}), ("infix", "-", "int", None, {0: NAME("a"), 1: NAME("c"), 2: NAME("d")}),
     {("OPERATOR_MISMATCH", 1, "+", "-"): 1, ("INFIX_EXTENDED_OPERAND_NUMBER_MISMATCH", 1, "+", "-"): 1, ("VARIABLE_NAME_MISMATCH", 1, "b", "c"): 1}, (True, True)),
    (("array", None, "int[]", None, {0: NAME("a")}), ("array", None, "int[]", None, {0: NAME("b"), 1: NAME("c")}), {("ARRAY_DIMENSION_MISMATCH", 1, None, None): 1}, (True, True)),
    (NAME("x"), NAME("x"), {}, (True, True)),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_expressions(spark, case):
    a, b, want, ok = CASES[case]
    assert differences(spark, expression("a", a) + expression("b", b)) == (Counter(want), ok)


def test_expressions_feed_the_weights(spark):
    from factloom.operators import metrics

    a, b, *_ = CASES[1]
    pairs = spark.createDataFrame([(1, "a", "b")], "pair long, e1 string, e2 string")
    df = matching.match_expressions(pairs, spark.createDataFrame(expression("a", a) + expression("b", b), NODES))
    assert metrics.weighted_differences(df, ["pair"]).first()["all_weight"] == 3
    none = spark.createDataFrame([], NODES)
    assert matching.match_expressions(pairs, none).count() == 0
    assert matching.parameterizable(pairs, matching.match_expressions(pairs, none)).first()["parameterizable"]


def test_renamed_variables(spark):
    rows = [(1, "i", "j"), (1, "i", "j"), (1, "n", "n"), (1, "a", "b"), (1, "a", "c"), (1, "x", "z"), (1, "y", "z"), (2, "i", "k"), (1, None, "q"), (1, "q", None)]
    got = {(r["pair"], r["v1"], r["v2"]): (r["uses"], r["renamed"]) for r in matching.renamed_variables(spark.createDataFrame(rows, "pair long, v1 string, v2 string")).collect()}
    assert got == {(1, "i", "j"): (2, True), (1, "n", "n"): (1, False), (1, "a", "b"): (1, False), (1, "a", "c"): (1, False), (1, "x", "z"): (1, False), (1, "y", "z"): (1, False), (2, "i", "k"): (1, True)}


def test_movable(spark):
    r = random.Random(4)
    statements = [(g, k, r.random() < 0.3) for g in "ab" for k in range(12)] + [("c", 0, None)]
    edges = [(g, r.randint(0, 11), r.randint(0, 11)) for g in "ab" for _ in range(14)]
    got = {(x["g"], x["node"]): (x["before"], x["after"]) for x in matching.movable(spark.createDataFrame(statements, "g string, node long, mapped boolean"), spark.createDataFrame(edges, "g string, src long, dst long")).collect()}
    mapped = {(g, k) for g, k, m in statements if m}

    def tied(start, forward, seen):
        for g, s, d in edges:
            a, b = (s, d) if forward else (d, s)
            if g == start[0] and a == start[1] and (g, b) not in seen and a != b:
                seen.add((g, b))
                if (g, b) not in mapped:
                    tied((g, b), forward, seen)
        return seen

    want = {(g, k): (not tied((g, k), False, set()) & mapped, not tied((g, k), True, set()) & mapped) for g, k, m in statements if not m}
    assert got == want and len(set(want.values())) > 2


def test_aliases_change_dependences_over_branch_and_loop(spark):
    """1: a = new; 2: if ...; 3: b = a; 4: b.f = ...; 5: use a.f; 6: a = new, back to 2. Without 3 there is no dependence of 5 on 4."""
    flow = [("m", 1, 2), ("m", 2, 3), ("m", 2, 5), ("m", 3, 4), ("m", 4, 5), ("m", 5, 6), ("m", 6, 2)]
    new = [("m", 1, "a", None), ("m", 6, "a", None)]
    kinds = ("g string, src long, dst long", "g string, node long, left string, right string", "g string, node long, var string, field string")
    defs, uses = [("m", 4, "b", "f")], [("m", 5, "a", "f")]

    def found(assigns):
        x = (spark.createDataFrame(flow, kinds[0]), spark.createDataFrame(assigns, kinds[1]))
        pairs = {(r["node"], r["a"], r["b"]) for r in effects.alias_pairs(*x).collect()}
        deps = {tuple(r)[1:] for r in effects.aliased_dependences(*x, spark.createDataFrame(defs, kinds[2]), spark.createDataFrame(uses, kinds[2])).collect()}
        return pairs, deps

    assert found([*new, ("m", 3, "b", "a")]) == ({(3, "a", "b"), (4, "a", "b"), (5, "a", "b")}, {(4, 5, "a", "f")})
    assert found(new) == (set(), set())
    assert found([*new, ("m", 3, "b", "b")]) == (set(), set())


def walked(flow, assigns, steps):
    """Alias pairs met on all walks of up to so many steps, by sets of names for each object."""
    out = defaultdict(set)

    def step(node, names, left):
        x, y = assigns.get(node, (None, None))
        if x is not None and x != y:
            names = [s - {x} for s in names]
            if y is not None:
                names = [s | {x} if y in s else s for s in names] if any(y in s for s in names) else [*names, {x, y}]
        for s in names:
            out[node] |= {(a, b) for a in s for b in s if a < b}
        if left:
            for to in flow.get(node, ()):
                step(to, names, left - 1)

    for node in {*flow, *assigns}:
        step(node, [], steps)
    return out


def test_aliases_against_walks():
    r = random.Random(7)
    for _ in range(60):
        n = r.randint(1, 5)
        flow = {k: r.sample(range(n), r.randint(0, min(2, n))) for k in range(n)}
        assigns = {k: (r.choice("abc"), r.choice(["a", "b", "c", None])) for k in range(n) if r.random() < 0.8}
        got = effects.aliases(flow, assigns)
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in walked(flow, assigns, 9).items() if v}


def test_side_effects(spark):
    r = random.Random(2)
    roots = ["this", "p1"]
    direct = [(f"m{r.randint(0, 5)}", r.choice(roots), [r.choice("xy")], r.choice(["read", "write"])) for _ in range(5)]
    bind = [(f"m{r.randint(0, 5)}", f"m{r.randint(0, 5)}", r.choice(roots), r.choice(roots), r.choice([[], ["z"]])) for _ in range(14)] + [("m0", "m0", "this", "this", ["n"])]
    got = {(x["method"], x["root"], tuple(x["path"]), x["mode"]): x["calls"] for x in effects.side_effects(spark.createDataFrame(direct, "method string, root string, path array<string>, mode string"), spark.createDataFrame(bind, "caller string, callee string, slot string, root string, path array<string>"), 4, 3).collect()}
    want = {}

    def read(method, root, path, mode, depth):
        key = (method, root, tuple(path), mode)
        if len(path) > 3 or depth > 4 or want.get(key, 9) <= depth:
            return
        want[key] = depth
        for caller, callee, slot, to, before in bind:
            if callee == method and slot == root:
                read(caller, to, [*before, *path], mode, depth + 1)

    for d in direct:
        read(*d, 0)
    assert got == want and len(want) > 10


def grown(one, two, kinds1, kinds2):
    """The size of a largest mapping that grows edge by edge, by trying everything."""
    def near(edges):
        out = defaultdict(set)
        for s, d, k in edges:
            out[s].add((d, k, 1))
            out[d].add((s, k, 0))
        return out

    n1, n2, seen = near(one), near(two), set()

    def grow(m):
        if m in seen:
            return 0
        seen.add(m)
        left, right = {a for a, _ in m}, {b for _, b in m}
        more = {(x, y) for a, b in m for x, k, w in n1[a] for y, j, v in n2[b] if (k, w) == (j, v) and x not in left and y not in right and kinds1[x] == kinds2[y]}
        return max([len(m), *(grow(m | {p}) for p in more)])

    return max([0, *(grow(frozenset([(a, b)])) for a in kinds1 for b in kinds2 if kinds1[a] == kinds2[b])])


def test_map_graphs_is_largest_and_ends():
    from factloom.operators import clones

    r = random.Random(3)
    for _ in range(150):
        graphs = []
        for _ in range(2):
            n = r.randint(1, 5)
            graphs.append(([(r.randint(0, n - 1), r.randint(0, n - 1), r.choice("cd")) for _ in range(r.randint(0, 6))], {k: r.choice("ab") for k in range(n)}))
        (one, k1), (two, k2) = graphs
        got, whole = clones.map_graphs(one, two, k1, k2)
        assert whole and len(got) == grown(one, two, k1, k2)
        assert len({a for a, _ in got}) == len({b for _, b in got}) == len(got) and all(k1[a] == k2[b] for a, b in got)
    star = [(0, k, "control") for k in range(1, 31)]
    kinds = {0: "if"} | {k: "s" for k in range(1, 31)}
    assert len(clones.map_graphs(star, star, kinds, kinds)[0]) == 31
    line = star + [(k, k + 1, "data") for k in range(1, 30)]
    assert len(clones.map_graphs(line, line, kinds, kinds)[0]) == 31
