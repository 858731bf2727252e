"""Control-dependence trees and their matching, against recursive readings of the same rules on small random methods."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from factloom.operators import trees as T

KINDS = ["if", "if", "if", "for", "try", "ternary", "statement", "while"]


def some_methods(seed, n, most):
    r = random.Random(seed)
    rows = []
    for g in range(n):
        for k in range(1, r.randint(0, most) + 1):
            rows.append((f"m{g}", k, r.choice([0, None, *range(max(0, k - 4), k)]), r.choice(KINDS), r.choice([True, False, None]), r.choice("AAB"), r.choice("xy")))
    return rows


SCHEMA = "g string, id long, parent long, kind string, on_false boolean, form string, text string"


class Node:
    def __init__(self, node, form):
        self.node, self.form, self.up, self.below, self.if_parent, self.chain = node, form, None, [], None, [self]

    @property
    def like(self):
        return (len(self.chain) if len(self.chain) > 1 else 0, self.form)

    def count(self):
        return 1 + sum(c.count() for c in self.below)


def grown(rows):
    """The tree of one method by recursion from the top: node -> Node."""
    by = {r[1]: r for r in rows}
    holder = lambda p: p if p in by and by[p][3] in (*T.PREDICATES, "try") else 0
    inside = defaultdict(list)
    for _, k, p, *_ in rows:
        inside[holder(p) if p is not None and p < k else 0].append(k)
    out = {0: Node(0, "entry")}

    def put(node, up):
        node.up = up
        up.below.append(node)
        out[node.node] = node
        return node

    def visit(k, home, stand):
        """What hangs on statement k: home is its node, stand the node it stands under."""
        kind = by[k][3] if k else "entry"
        falses = [c for c in inside[k] if kind == "if" and by[c][4]]
        for c in inside[k]:
            ck = by[c][3]
            below_else = c in falses
            if below_else and len(falses) == 1 and ck == "if":
                n = put(Node(c, by[c][5]), stand)
                n.if_parent = home
                n.chain = home.chain
                n.chain.append(n)
                visit(c, n, stand)
                continue
            to = home
            if below_else:
                to = out.get(-k)
                if to is None:
                    to = put(Node(-k, "else of " + home.form), stand)
                    to.if_parent, to.chain = home, home.chain
                    to.chain.append(to)
            if ck in T.PREDICATES or ck == "ternary" or (ck == "try" and inside[c]):
                visit(c, put(Node(c, by[c][5]), to), to)

    visit(0, out[0], None)
    for n in out.values():
        n.below.sort(key=lambda c: (abs(c.node), -c.node))
    return out


def matched(a, b):
    """All pairs of a top-down match that covers both sub-trees, or None: the first like child is taken, as it comes."""
    if a.like != b.like or len(a.below) != len(b.below):
        return None
    pairs, left = [(a.node, b.node)], list(a.below)
    for y in b.below:
        x = next((x for x in left if x.like == y.like), None)
        if x is None or (inner := matched(x, y)) is None:
            return None
        left.remove(x)
        pairs += inner
    return pairs


def climbed(t1, t2):
    """Bottom-up matches of two trees: leaf -> set of pairs."""
    leaves = lambda t: sorted((n for k, n in t.items() if k and not n.below and not any(s.below for s in n.up.below)), key=lambda n: (abs(n.node), n.node))
    starts, used = [], set()
    for a in leaves(t1):
        b = next((b for b in leaves(t2) if b.like == a.like), None)
        if b is not None and (a.up.node, b.up.node) not in used:
            used.add((a.up.node, b.up.node))
            starts.append((a, b))

    def beside(one, two):
        left, out = list(two), []
        for x in sorted(one, key=lambda c: (abs(c.node), -c.node)):
            y = next((y for y in sorted(left, key=lambda c: (abs(c.node), -c.node)) if y.like == x.like), None)
            if y is not None:
                left.remove(y)
                out.append((x, y))
        return out

    found = {}
    for a, b in starts:
        leaf, pairs = a.node, set()
        while True:
            mates = beside([n for n in a.chain if n is not a], [n for n in b.chain if n is not b])
            if len(a.chain) > 1 and len(mates) != len(a.chain) - 1:
                break
            pairs.add((a.node, b.node))
            for x, y in [*mates, *beside([n for n in a.up.below if n is not a], [n for n in b.up.below if n is not b])]:
                pairs.update(matched(x, y) or [(x.node, y.node)])
            a, b = a.up, b.up
            if not a.node or not b.node or a.like != b.like:
                break
        if pairs:
            found[leaf] = pairs
    sides = {k: ({x for x, _ in p}, {y for _, y in p}) for k, p in found.items()}
    inside = lambda k, o: sides[k][0] <= sides[o][0] and sides[k][1] <= sides[o][1]
    return {k: p for k, p in found.items() if not any(o != k and inside(k, o) and (not inside(o, k) or o < k) for o in found)}


@pytest.fixture(scope="module")
def forest(spark):
    rows = some_methods(3, 40, 14)
    df = spark.createDataFrame(rows, SCHEMA)
    shapes = T.shaped(T.control_trees(df)).cache()
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    return rows, shapes, {g: grown(x) for g, x in by.items()}


def test_control_trees(forest):
    _, shapes, want = forest
    got = {(r["g"], r["node"]): (r["parent"], r["level"], r["form"], r["if_parent"], r["size"]) for r in shapes.collect()}
    depth = lambda n: 0 if n.up is None else 1 + depth(n.up)
    assert got == {(g, k): (n.up and n.up.node, depth(n), n.form, n.if_parent and n.if_parent.node, n.count()) for g, t in want.items() for k, n in t.items()}
    assert any(k < 0 for _, k in got) and any(n.if_parent and n.node > 0 for t in want.values() for n in t.values())


def test_like_subtrees_are_all_maximal_top_down_matches(forest):
    _, shapes, want = forest
    rows = T.like_subtrees(shapes).collect()
    got = {((r["g"], r["node"]), (s["g"], s["node"])) for r in rows for s in rows if r["shape"] == s["shape"] and r["context"] != s["context"]}
    nodes = [((g, k), n) for g, t in want.items() for k, n in t.items() if k]
    full = {(i, j) for i, a in nodes for j, b in nodes if i != j and matched(a, b)}
    inner = set()
    of = dict(nodes)
    for i, j in full:
        inner.update({((i[0], x), (j[0], y)) for x, y in matched(of[i], of[j])[1:]})
    assert got == full - inner and len(got) > 50


def test_bottom_up(spark, forest):
    _, shapes, want = forest
    r = random.Random(1)
    names = sorted(want)
    pairs = [(k, *r.sample(names, 2)) for k in range(60)] + [(60 + k, g, g) for k, g in enumerate(names[:15])]
    got = defaultdict(lambda: defaultdict(set))
    for x in T.bottom_up(spark.createDataFrame(pairs, "pair long, g1 string, g2 string"), shapes).collect():
        got[x["pair"]][x["solution"]].add((x["a"], x["b"]))
    for k, g1, g2 in pairs:
        assert dict(got[k]) == climbed(want[g1], want[g2]), k
    assert sum(len(p) > 4 for s in got.values() for p in s.values()) > 5


def mapped_by_hand(matches, rows):
    """Level by level, round by round, over lists."""
    taken, out = [], {}
    for level in sorted({m["level"] for m in matches}, reverse=True):
        cand = [(s, t) for m in matches if m["level"] == level for s in rows[m["g1"]] if s["node"] == m["a"] for t in rows[m["g2"]] if t["node"] == m["b"] and t["form"] == s["form"]]
        while cand:
            agree = lambda s, t: sum(x in s["deps"] and y in t["deps"] for x, y in taken)
            rank = lambda p: (-agree(*p), p[0]["text"] != p[1]["text"], p[0]["id"], p[1]["id"])
            one, two = {}, {}
            for p in sorted(cand, key=rank):
                one.setdefault(p[0]["id"], p)
                two.setdefault(p[1]["id"], p)
            now = [p for p in one.values() if two[p[1]["id"]] is p]
            for s, t in now:
                out[s["id"]] = (t["id"], level, s["text"] != t["text"])
            taken += [(s["id"], t["id"]) for s, t in now]
            ones, twos = {s["id"] for s, _ in now}, {t["id"] for _, t in now}
            cand = [p for p in cand if p[0]["id"] not in ones and p[1]["id"] not in twos]
    return out


def test_map_levels(spark, forest):
    _, shapes, want = forest
    r = random.Random(9)
    rows = {g: [{"g": g, "id": 100 + k, "node": r.choice(sorted(t)), "form": r.choice("pq"), "text": r.choice("uv"), "deps": sorted(r.sample(range(100, 130), r.randint(0, 6)))} for k in range(30)] for g, t in want.items()}
    names = sorted(want)
    pairs = spark.createDataFrame([(k, *r.sample(names, 2)) for k in range(12)] + [(20 + k, g, g) for k, g in enumerate(names[:6])], "pair long, g1 string, g2 string")
    level = shapes.select(shapes["g"].alias("g1"), shapes["node"].alias("a"), "level")
    matches = T.bottom_up(pairs, shapes).join(pairs, "pair").join(level, ["g1", "a"]).cache()
    df = spark.createDataFrame([x for v in rows.values() for x in v], "g string, id long, node long, form string, text string, deps array<long>")
    got = defaultdict(dict)
    for x in T.map_levels(matches, df).collect():
        got[x["pair"], x["solution"]][x["a"]] = (x["b"], x["level"], x["differs"])
    by = defaultdict(list)
    for m in matches.collect():
        by[m["pair"], m["solution"]].append(m.asDict())
    for key, ms in by.items():
        assert got[key] == mapped_by_hand(ms, rows), key
    assert sum(map(len, got.values())) > 20


def test_empty_and_odd(spark):
    none = spark.createDataFrame([], SCHEMA)
    shapes = T.shaped(T.control_trees(none))
    assert shapes.count() == 0 and T.like_subtrees(shapes).count() == 0
    assert T.bottom_up(spark.createDataFrame([(1, "a", "b")], "pair long, g1 string, g2 string"), shapes).count() == 0
    # A parent that comes later, is missing, or is itself; a null form; a method of null name joins nothing.
    odd = spark.createDataFrame([("a", 1, 2, "if", None, None, None), ("a", 2, 2, "for", True, "x", None), ("a", 3, 9, "if", None, "x", None), (None, 1, None, "if", None, "x", None)], SCHEMA)
    got = Counter((r["g"], r["node"], r["parent"], r["level"]) for r in T.control_trees(odd.filter("g IS NOT NULL")).collect())
    assert got == Counter([("a", 0, None, 0), ("a", 1, 0, 1), ("a", 2, 0, 1), ("a", 3, 0, 1)])


def test_pairs_and_levels_take_no_rounds(spark, forest, monkeypatch):
    """A pair is matched, and a solution mapped, in one row: no table is written on the way, nothing is sent through the driver."""
    _, shapes, want = forest
    monkeypatch.setattr(T, "settled", None)
    names = sorted(want)
    pairs = spark.createDataFrame([(k, *names[k : k + 2]) for k in range(10)], "pair long, g1 string, g2 string")
    found = T.bottom_up(pairs, shapes)
    matches = found.join(pairs, "pair").withColumn("level", F.lit(1))
    rows = spark.createDataFrame([(g, 1, 1, "p", "u", None) for g in names], "g string, id long, node long, form string, text string, deps array<long>")
    mapped = T.map_levels(matches, rows)
    assert mapped.count() >= 0 and mapped.columns == ["pair", "solution", "a", "b", "level", "differs"]
    assert "Broadcast" not in found._jdf.queryExecution().optimizedPlan().toString() and "strategy=merge" in found._jdf.queryExecution().optimizedPlan().toString()
