"""Control-dependence trees of methods as tables, and the matching of like sub-trees.

statements: g (method), id (from 1, in order), parent (the predicate or try block directly around, null at the top), kind,
on_false (it runs in the false branch of its parent), form (what two nodes must share to match: the normalised predicate).
trees: g, node, parent, level, form, if_parent, size, shape. The entry is node 0; the else part of an `if` p is node -p.

Trees are built a level at a time, all methods at once, by joins on (g, node). No two methods meet unless they share a
sub-tree or are given as a pair; a given pair is a row with both trees, which are as small as a method, and climbs in a kernel.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .graph import settled

#: Kinds of statements that decide whether others run. A ternary is a statement that is a tree's leaf.
PREDICATES = ("if", "for", "while", "do", "foreach", "switch", "catch", "synchronized")
BLOCK, TERNARY = "try", "ternary"


def _jump(links: DataFrame) -> DataFrame:
    """g, node, top, steps: where pointers (g, node, up) end, each round doubling what a pointer spans."""
    now = settled(links.select("g", "node", F.col("up").alias("top"), F.lit(1).cast("long").alias("steps")))
    while True:
        far = now.select("g", F.col("node").alias("top"), F.col("top").alias("next"), F.col("steps").alias("more"))
        after = settled(now.join(far, ["g", "top"], "left").select("g", "node", F.coalesce("next", "top").alias("top"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("moved")))
        if after.filter("moved").isEmpty():
            return after.drop("moved")
        now = after.drop("moved")


def control_trees(statements: DataFrame) -> DataFrame:
    """The trees of all methods, without sizes and shapes.

    Predicates, ternaries and try blocks with something inside are nodes. An `else if` that is all its `if` has in the false
    branch stands beside that `if`; whatever else runs in a false branch hangs on an else node beside the `if`. Parents that are
    neither predicates nor blocks, don't exist, or come later, count as the entry. if_parent links a node to the `if` it follows.
    """
    s = statements.select("g", F.col("id").cast("long").alias("node"), F.when(F.col("parent") < F.col("id"), F.col("parent").cast("long")).otherwise(F.lit(0)).alias("up"), "kind", F.coalesce("on_false", F.lit(False)).alias("on_false"), F.coalesce("form", F.lit("")).alias("form"))
    holds = s.filter(F.col("kind").isin(*PREDICATES, BLOCK)).select("g", F.col("node").alias("up"), F.col("kind").alias("up_kind"))
    x = s.join(holds.hint("merge"), ["g", "up"], "left").withColumn("up", F.when(F.col("up_kind").isNotNull(), F.col("up")).otherwise(F.lit(0)))
    x = x.withColumn("below_else", F.coalesce((F.col("up_kind") == "if") & F.col("on_false"), F.lit(False)))
    beside = F.sum(F.col("below_else").cast("int")).over(W.partitionBy("g", "up"))
    x = settled(x.withColumn("else_if", F.col("below_else") & (beside == 1) & (F.col("kind") == "if")))
    used = x.select("g", F.col("up").alias("node")).distinct()
    member = F.col("kind").isin(*PREDICATES, TERNARY)
    own = x.filter(member).unionByName(x.filter(F.col("kind") == BLOCK).join(used, ["g", "node"], "left_semi"))
    # An else if stands where the first `if` of its chain stands, and so does an else.
    chain = _jump(own.filter("else_if").select("g", "node", "up"))
    first = x.select("g", F.col("node").alias("top"), "up", "below_else")
    place = F.when(F.col("below_else"), -F.col("up")).otherwise(F.col("up")).alias("parent")
    plain = own.filter("NOT else_if").select("g", "node", place, "form", "kind", F.lit(None).cast("long").alias("if_parent"))
    later = own.filter("else_if").select("g", "node", "form", "kind", F.col("up").alias("if_parent")).join(chain, ["g", "node"]).join(first, ["g", "top"]).select("g", "node", place, "form", "kind", "if_parent")
    nodes = settled(plain.unionByName(later))
    parts = x.filter("below_else AND NOT else_if").select("g", F.col("up").alias("if_parent")).distinct()
    elses = parts.join(nodes.select("g", F.col("node").alias("if_parent"), "parent", "form"), ["g", "if_parent"]).select("g", (-F.col("if_parent")).alias("node"), "parent", F.concat(F.lit("else of "), "form").alias("form"), F.lit("else").alias("kind"), "if_parent")
    entries = s.select("g").distinct().select("g", F.lit(0).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit("entry").alias("form"), F.lit("entry").alias("kind"), F.lit(None).cast("long").alias("if_parent"))
    every = settled(nodes.unionByName(elses))
    level = _jump(every.select("g", "node", F.col("parent").alias("up"))).select("g", "node", F.col("steps").cast("int").alias("level"))
    return settled(every.join(level, ["g", "node"]).unionByName(entries.withColumn("level", F.lit(0))))


def _order() -> list[Column]:
    return [F.abs("node"), F.desc("node")]


def shaped(trees: DataFrame) -> DataFrame:
    """trees with `chain` (the first `if` of an if-else chain, null outside), `length` (members of that chain), `nth` (among
    its siblings of the same form and chain length), `size` of its sub-tree, and `shape`.

    Two nodes have the same shape where a top-down match covers both sub-trees whole: same form and chain length, and their
    children, taken in order by form, have the same shapes. Shapes come from the deepest level upwards.
    """
    links = trees.filter("if_parent IS NOT NULL").select("g", "node", F.col("if_parent").alias("up"))
    chained = _jump(links).select("g", "node", F.col("top").alias("chain"))
    heads = chained.select("g", F.col("chain").alias("node"), "chain").distinct()
    x = trees.join(chained.unionByName(heads), ["g", "node"], "left")
    length = F.when(F.col("chain").isNotNull(), F.count(F.lit(1)).over(W.partitionBy("g", "chain"))).otherwise(F.lit(0))
    x = x.withColumn("length", length).withColumn("like", F.concat_ws("|", F.col("length").cast("string"), "form"))
    x = settled(x.withColumn("nth", F.row_number().over(W.partitionBy("g", "parent", "like").orderBy(*_order()))))
    deepest = x.agg(F.max("level")).first()[0]
    done, below = None, None
    for level in range(deepest if deepest is not None else -1, -1, -1):
        here = x.filter(F.col("level") == level)
        if below is not None:
            inside = below.groupBy("g", F.col("parent").alias("node")).agg(F.array_sort(F.collect_list(F.struct("like", "nth", "shape"))).alias("c"), F.sum("size").alias("n"))
            here = here.join(inside.select("g", "node", F.col("c.shape").alias("c"), "n"), ["g", "node"], "left")
        else:
            here = here.withColumn("c", F.lit(None).cast("array<string>")).withColumn("n", F.lit(0).cast("long"))
        parts = F.concat_ws(",", F.coalesce("c", F.array().cast("array<string>")))
        below = settled(here.select(*x.columns, (1 + F.coalesce("n", F.lit(0))).cast("long").alias("size"), F.sha2(F.concat_ws("#", "like", parts), 256).alias("shape")))
        done = below if done is None else done.unionByName(below)
    return settled(done) if done is not None else x.withColumn("size", F.lit(1).cast("long")).withColumn("shape", F.col("like"))


def like_subtrees(shapes: DataFrame, least: int = 1) -> DataFrame:
    """g, node, size, shape, context: sub-trees with the same shape as another one, wherever a match of two is maximal.

    A match of two sub-trees lies inside a larger one where both are the same child of parents with one shape; such nodes have
    one context. So the maximal matches of a shape are all pairs of its nodes with different contexts; they are kept as classes,
    not as pairs. Children of an entry have contexts of their own, since entries don't match. Shapes with one context are left out.
    """
    x = shapes.filter((F.col("node") != 0) & (F.col("size") >= least))
    up = shapes.select("g", F.col("node").alias("parent"), F.col("shape").alias("above"), (F.col("parent").isNull()).alias("top"))
    x = x.join(up, ["g", "parent"])
    alone = F.concat_ws("/", F.lit("top"), F.col("g").cast("string"), F.col("node").cast("string"))
    x = x.withColumn("context", F.when(F.col("top"), alone).otherwise(F.concat_ws("/", "above", "like", F.col("nth").cast("string"))))
    contexts = x.groupBy("shape").agg(F.count_distinct("context").alias("contexts")).filter("contexts > 1")
    return x.join(contexts.select("shape"), "shape", "left_semi").select("g", "node", "size", "shape", "context")


def _side(shapes: DataFrame, k: int) -> DataFrame:
    names = ("g", "node", "parent", "like", "nth", "chain", "length", "size", "shape", "level")
    return shapes.select(*(F.col(n).alias(n + str(k)) for n in names))


def top_down(seeds: DataFrame, shapes: DataFrame) -> DataFrame:
    """key, g1, a, g2, b: seeds and, level by level, their children of like form in order. With equal shapes this maps both
    sub-trees whole."""
    one, two = _side(shapes, 1), _side(shapes, 2)
    now = settled(seeds.select("key", "g1", "a", "g2", "b"))
    out = now
    while True:
        left = now.join(one, (now["g1"] == one["g1"]) & (now["a"] == one["parent1"])).select("key", now["g1"], now["g2"], "a", "b", F.col("node1").alias("x"), F.col("like1").alias("like"), F.col("nth1").alias("nth"))
        right = two.select("g2", F.col("parent2").alias("b"), F.col("node2").alias("y"), F.col("like2").alias("like"), F.col("nth2").alias("nth"))
        now = settled(left.join(right, ["g2", "b", "like", "nth"]).select("key", "g1", F.col("x").alias("a"), "g2", F.col("y").alias("b")))
        if now.isEmpty():
            return out
        out = out.unionByName(now)


class _Tree:
    """The tree of one method; siblings, and the members of a chain, in order."""

    def __init__(self, node: list[int], parent: list[int | None], chain: list[int | None], like: list[str], nth: list[int], shape: list[str]):
        self.parent, self.chain, self.like, self.nth, self.shape = (dict(zip(node, x, strict=True)) for x in (parent, chain, like, nth, shape))
        self.below, self.mates = defaultdict(list), defaultdict(list)
        for n in sorted(node, key=lambda n: (abs(n), -n)):
            self.below[self.parent[n]].append(n)
            if self.chain[n] is not None:
                self.mates[self.chain[n]].append(n)

    def starts(self) -> list[int]:
        """Leaves that have leaves beside them alone, by place."""
        holders = {self.parent[n] for n in self.parent if n in self.below}
        return sorted((n for n, up in self.parent.items() if n and n not in self.below and up not in holders), key=lambda n: (abs(n), n))


def _beside(one: _Tree, two: _Tree, left: list[int], right: list[int]) -> Iterator[tuple[int, int]]:
    """Like nodes of both lists, in order."""
    by = defaultdict(list)
    for y in reversed(right):
        by[two.like[y]].append(y)
    for x in left:
        if by[one.like[x]]:
            yield x, by[one.like[x]].pop()


def _whole(one: _Tree, two: _Tree, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Two sub-trees of one shape, node by node."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        yield a, b
        spot = {(two.like[y], two.nth[y]): y for y in two.below.get(b, ())}
        todo += [(x, spot[one.like[x], one.nth[x]]) for x in one.below.get(a, ()) if (one.like[x], one.nth[x]) in spot]


def _climbed(one: _Tree, two: _Tree) -> dict[int, set[tuple[int, int]]]:
    """The matches of two trees by their first leaf (see bottom_up)."""
    first, used, found = {}, set(), {}
    for b in two.starts():
        first.setdefault(two.like[b], b)
    others = lambda of, key, n: [x for x in of.get(key, ()) if x != n]
    for leaf in one.starts():
        a, b = leaf, first.get(one.like[leaf])
        if b is None or (one.parent[a], two.parent[b]) in used:
            continue
        used.add((one.parent[a], two.parent[b]))
        pairs = set()
        while True:
            near = list(_beside(one, two, others(one.mates, one.chain[a], a), others(two.mates, two.chain[b], b)))
            if one.chain[a] is not None and len(near) != len(one.mates[one.chain[a]]) - 1:
                break
            pairs.add((a, b))
            near += _beside(one, two, others(one.below, one.parent[a], a), others(two.below, two.parent[b], b))
            for x, y in near:
                pairs.update(_whole(one, two, x, y) if one.shape[x] == two.shape[y] else [(x, y)])
            a, b = one.parent[a], two.parent[b]
            if not a or not b or one.like.get(a) is None or one.like[a] != two.like.get(b):
                break
        if pairs:
            found[leaf] = pairs
    sides = {k: ({a for a, _ in p}, {b for _, b in p}) for k, p in found.items()}
    inside = lambda k, o: sides[k][0] <= sides[o][0] and sides[k][1] <= sides[o][1]
    return {k: p for k, p in found.items() if not any(o != k and inside(k, o) and (not inside(o, k) or o < k) for o in found)}


def _by_row(column: pa.Array) -> Iterator[list[list]]:
    """The fields of each row's array of structs, as lists."""
    fields = [x.to_pylist() for x in column.flatten().flatten()]
    at = column.offsets.to_pylist()
    for lo, hi in zip(at, at[1:], strict=False):
        yield [f[lo - at[0] : hi - at[0]] for f in fields]


def _kernel(names: list[str], schema: pa.Schema, run: Callable[..., Iterator[tuple]], keys: int, rows: int = 64) -> Callable:
    """Batches of rows of `keys` columns and arrays of structs: each row's keys with what `run` makes of its arrays."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, rows):
                b = whole.slice(k, rows)
                got = [(i, *x) for i, arrays in enumerate(zip(*map(_by_row, b.columns[keys:]), strict=True)) for x in run(*arrays)]
                at, *out = zip(*got, strict=True) if got else ([], *([] for _ in schema))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in b.columns[:keys]), *(pa.array(x, f.type) for x, f in zip(out, schema, strict=True))], names=names)

    return over


def bottom_up(pairs: DataFrame, shapes: DataFrame) -> DataFrame:
    """pair, solution, a, b: the maximal matches of the trees of each pair (pair, g1, g2), from leaves upwards.

    A match starts at two like leaves that have leaves beside them alone, takes in what is like among their siblings, whole
    where the shapes agree and the sibling alone where not, and climbs while parents are like. In an if-else chain every
    member must find its partner, or the match stops below. Each leaf starts once, with the first like leaf of the other tree,
    and two parents start once. A match whose nodes lie in another one's, on both sides, goes; solutions are numbered by their
    first leaf.
    """
    trees = shapes.groupBy("g").agg(F.collect_list(F.struct("node", "parent", "chain", "like", "nth", "shape")).alias("tree"))
    of = lambda k: trees.select(F.col("g").alias(f"g{k}"), F.col("tree").alias(f"tree{k}")).hint("merge")
    met = pairs.join(of(1), "g1").join(of(2), "g2").select("pair", "tree1", "tree2")
    run = lambda one, two: ((leaf, a, b) for leaf, found in _climbed(_Tree(*one), _Tree(*two)).items() for a, b in found)
    names = ["pair", "solution", "a", "b"]
    kind = shapes.schema["node"].dataType
    return met.mapInArrow(_kernel(names, pa.schema([(n, pa.int64()) for n in names[1:]]), run, 1), StructType([pairs.schema["pair"], *(StructField(n, kind) for n in names[1:])]))


def _by_levels(level: list[int | None], s1: list[int], s2: list[int], differs: list[bool], d1: list[list[int]], d2: list[list[int]]) -> Iterator[tuple[int, int, int, bool]]:
    """What map_levels takes of one solution: s1, s2, level, differs."""
    mapped: dict[int, int] = {}
    for now in sorted({x for x in level if x is not None}, reverse=True):
        left, taken = [k for k, x in enumerate(level) if x == now], set(mapped.values())
        while left := [k for k in left if s1[k] not in mapped and s2[k] not in taken]:
            agree = {k: sum(x in mapped and mapped[x] in d2[k] for x in set(d1[k])) for k in left}
            one, two = {}, {}
            for k in sorted(left, key=lambda k: (-agree[k], differs[k], s1[k], s2[k])):
                one.setdefault(s1[k], k)
                two.setdefault(s2[k], k)
            for k in one.values():
                if two[s2[k]] == k:
                    mapped[s1[k]] = s2[k]
                    taken.add(s2[k])
                    yield s1[k], s2[k], now, differs[k]


def map_levels(matches: DataFrame, statements: DataFrame) -> DataFrame:
    """pair, solution, a, b, level, differs: the statements mapped below each matched pair of tree nodes, deepest level first.

    matches: pair, solution, g1, a, g2, b, level. statements: g, id, node (the tree node they hang on), form, text, and deps
    (ids of the statements they depend on, or null). Below two matched nodes statements of like form can be mapped to each
    other. Levels are worked off one after another; within a level, pairs are taken in rounds: each round takes the pairs that
    are the best choice of both their sides, by dependences that end in statements mapped to each other before, equal texts,
    and order. So every round maps at least one statement below any node that has some left. A solution of a pair is
    a row of a kernel, with the statements that can meet.
    """
    side = lambda k: statements.select(F.col("g").alias(f"g{k}"), F.col("node").alias("ab"[k - 1]), F.col("id").alias(f"s{k}"), "form", F.col("text").alias(f"t{k}"), F.coalesce("deps", F.array().cast("array<long>")).alias(f"d{k}"))
    spot = ["pair", "solution"]
    cand = matches.join(side(1).hint("merge"), ["g1", "a"]).join(side(2).hint("merge"), ["g2", "b", "form"])
    cand = cand.groupBy(*spot).agg(F.collect_list(F.struct("level", "s1", "s2", F.coalesce(F.col("t1") != F.col("t2"), F.lit(True)).alias("differs"), "d1", "d2")).alias("all"))
    names, long = ["a", "b", "level", "differs"], statements.schema["id"].dataType
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("level", pa.int32()), ("differs", pa.bool_())])
    kinds = (long, long, matches.schema["level"].dataType, BooleanType())
    return cand.mapInArrow(_kernel([*spot, *names], out, lambda all_: _by_levels(*all_), 2), StructType([*(matches.schema[c] for c in spot), *map(StructField, names, kinds)]))


def rank_matches(matches: DataFrame) -> DataFrame:
    """pair, solution, size, rank: solutions of a pair by the nodes that they map, most first, then by number."""
    n = matches.groupBy("pair", "solution").agg(F.count(F.lit(1)).alias("size"))
    return n.withColumn("rank", F.row_number().over(W.partitionBy("pair").orderBy(F.desc("size"), "solution")))
