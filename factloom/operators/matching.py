"""Matching of expressions node by node with weighted differences, and what follows from it for a pair of fragments.

Expressions are tables: e (expression), node, parent (null at the root), position (among its siblings; 0 is a call's receiver),
kind (`name`, `literal`, `call`, `infix`, `array`, or any other), value (name, literal, operator), type, and super (the
supertype that its type shares with others, or null). All pairs of expressions are matched together, a level a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import reached, settled, steps_by

#: What differs where two nodes of one kind have different values, or different numbers of children.
VALUE_DIFFERENCES = {"name": "VARIABLE_NAME_MISMATCH", "literal": "LITERAL_VALUE_MISMATCH", "call": "METHOD_INVOCATION_NAME_MISMATCH", "infix": "OPERATOR_MISMATCH"}
NUMBER_DIFFERENCES = {"call": "ARGUMENT_NUMBER_MISMATCH", "infix": "INFIX_EXTENDED_OPERAND_NUMBER_MISMATCH", "array": "ARRAY_DIMENSION_MISMATCH"}
#: Differences that no parameter can take up.
TYPE_MISMATCHES = ("AST_TYPE_MISMATCH", "VARIABLE_TYPE_MISMATCH")
#: Children that always pair by place; those from here on pair only if both nodes have as many.
FIRST_COUNTED = {"call": 1, "infix": 2, "array": 0}


def _sizes(nodes: DataFrame) -> DataFrame:
    """nodes with `size` of their sub-tree and `counted`, the number of children that must agree in number."""
    first = F.create_map(*(F.lit(x) for kv in FIRST_COUNTED.items() for x in kv))
    kids = nodes.filter("parent IS NOT NULL").select("e", F.col("node").alias("child"), F.col("parent").alias("node"), "position")
    own = nodes.select("e", "node", "kind").join(kids, ["e", "node"]).groupBy("e", "node").agg(F.count_if(F.col("position") >= F.coalesce(first[F.col("kind")], F.lit(1 << 30))).alias("counted"))
    up = settled(nodes.select("e", "node", F.col("parent").alias("at")))
    every = up.select("e", "node")
    step = nodes.select("e", F.col("node").alias("at"), F.col("parent").alias("next"))
    now = up.filter("at IS NOT NULL")
    while not now.isEmpty():
        every = every.unionByName(now.select("e", F.col("at").alias("node")))
        now = settled(now.join(step, ["e", "at"]).filter("next IS NOT NULL").select("e", "node", F.col("next").alias("at")))
    size = every.groupBy("e", "node").agg(F.count(F.lit(1)).alias("size"))
    return settled(nodes.join(size, ["e", "node"]).join(own, ["e", "node"], "left").withColumn("counted", F.coalesce("counted", F.lit(0))))


def _compare(now: DataFrame, nodes: DataFrame) -> DataFrame:
    """now (pair, e1, n1, e2, n2) with both nodes' columns, their differences (found), and whether to go on below."""
    of = lambda k: nodes.select(F.col("e").alias(f"e{k}"), F.col("node").alias(f"n{k}"), *(F.col(c).alias(f"{c}{k}") for c in ("kind", "value", "type", "super", "size", "counted")), F.col("receiver").alias(f"receiver{k}"))
    x = now.join(of(1), ["e1", "n1"]).join(of(2), ["e2", "n2"])
    same = F.col("kind1") == F.col("kind2")
    typed = F.col("type1").eqNullSafe(F.col("type2"))
    akin = F.coalesce(~typed & (F.col("super1") == F.col("super2")), F.lit(False))
    names = F.create_map(*(F.lit(v) for kv in VALUE_DIFFERENCES.items() for v in kv))
    numbers = F.create_map(*(F.lit(v) for kv in NUMBER_DIFFERENCES.items() for v in kv))
    number = F.col("counted1") != F.col("counted2")
    one = lambda when, kind, weight=None: F.when(when, F.struct(kind.alias("kind"), (F.lit(1) if weight is None else weight).cast("long").alias("weight")))
    found = F.array(
        one(same & ~F.col("value1").eqNullSafe(F.col("value2")) & names[F.col("kind1")].isNotNull(), names[F.col("kind1")]),
        one(same & ~typed & ~akin, F.lit("VARIABLE_TYPE_MISMATCH")),
        one(akin, F.lit("SUBCLASS_TYPE_MISMATCH")),
        one(same & number, F.coalesce(numbers[F.col("kind1")], F.lit("ARGUMENT_NUMBER_MISMATCH"))),
        one(same & (F.col("kind1") == "call") & (F.col("receiver1") != F.col("receiver2")), F.lit("MISSING_METHOD_INVOCATION_EXPRESSION")),
        one(~same & (typed | akin), F.lit("TYPE_COMPATIBLE_REPLACEMENT"), F.greatest("size1", "size2")),
        one(~same & ~typed & ~akin, F.lit("AST_TYPE_MISMATCH")),
    )
    return x.withColumn("found", F.filter(found, lambda d: d.isNotNull())).withColumn("below", same).withColumn("even", ~number)


def match_expressions(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pair, n1, n2, kind, weight, left, right, difference: the differences of each pair (pair, e1, e2) of expressions.

    Nodes of one kind are compared by value, type and number of children, and their children in order; nodes of different kinds
    replace each other where their types agree, at a weight of the larger one's nodes, and are a mismatch otherwise. Both end the
    comparison there. Children that must agree in number aren't compared where they don't. `difference` names the texts that
    differ, so that a repeated difference can be counted once.
    """
    receiver = nodes.filter("position = 0").select("e", F.col("parent").alias("node"), F.lit(True).alias("receiver")).distinct()
    x = settled(_sizes(nodes).join(receiver, ["e", "node"], "left").withColumn("receiver", F.coalesce("receiver", F.lit(False))))
    root = x.filter("parent IS NULL").select("e", "node")
    now = pairs.join(root.select(F.col("e").alias("e1"), F.col("node").alias("n1")), "e1").join(root.select(F.col("e").alias("e2"), F.col("node").alias("n2")), "e2")
    first = F.create_map(*(F.lit(v) for kv in FIRST_COUNTED.items() for v in kv))
    kids = x.filter("parent IS NOT NULL").select("e", F.col("parent").alias("p"), "position", "node")
    out = None
    while True:
        here = settled(_compare(now, x))
        if out is not None and here.isEmpty():
            break
        met = here.filter(F.size("found") > 0).select("pair", "n1", "n2", F.inline("found"), F.col("value1").alias("left"), F.col("value2").alias("right"))
        out = met if out is None else out.unionByName(met)
        a = kids.select(F.col("e").alias("e1"), F.col("p").alias("n1"), "position", F.col("node").alias("m1"))
        b = kids.select(F.col("e").alias("e2"), F.col("p").alias("n2"), "position", F.col("node").alias("m2"))
        on = here.filter("below").select("pair", "e1", "n1", "e2", "n2", "even", F.coalesce(first[F.col("kind1")], F.lit(1 << 30)).alias("from"))
        now = on.join(a, ["e1", "n1"]).filter("even OR position < from").join(b, ["e2", "n2", "position"]).select("pair", "e1", F.col("m1").alias("n1"), "e2", F.col("m2").alias("n2"))
    return out.withColumn("difference", F.concat_ws(" / ", F.coalesce("left", F.lit("")), F.coalesce("right", F.lit(""))))


def parameterizable(pairs: DataFrame, differences: DataFrame) -> DataFrame:
    """pair, matches (no mismatch of types), parameterizable: whether parameters can take up all differences of a pair.

    They can where nothing but variables' types differ beside names alone (of variables or of calls) and literals. They can't
    where a call lacks its receiver, has another name, and takes other arguments, or where types don't match.
    """
    has = lambda *kinds: F.coalesce(F.bool_or(F.col("kind").isin(*kinds)), F.lit(False))
    light = ("VARIABLE_TYPE_MISMATCH", "SUBCLASS_TYPE_MISMATCH", "VARIABLE_NAME_MISMATCH", "METHOD_INVOCATION_NAME_MISMATCH", "LITERAL_VALUE_MISMATCH")
    x = pairs.select("pair").distinct().join(differences.select("pair", "kind"), "pair", "left").groupBy("pair").agg(
        F.count("kind").alias("n"), F.count_if(~F.col("kind").isin(*light)).alias("heavy"), has("VARIABLE_NAME_MISMATCH").alias("names"), has("METHOD_INVOCATION_NAME_MISMATCH").alias("calls"),
        has("MISSING_METHOD_INVOCATION_EXPRESSION").alias("receiver"), has("ARGUMENT_NUMBER_MISMATCH", "TYPE_COMPATIBLE_REPLACEMENT").alias("arguments"), has(*TYPE_MISMATCHES).alias("types"),
    )
    types_alone = (F.col("n") > 0) & (F.col("heavy") == 0) & ~(F.col("names") & F.col("calls"))
    lost = F.col("receiver") & F.col("calls") & F.col("arguments")
    return x.select("pair", (~F.col("types")).alias("matches"), (types_alone | (~lost & ~F.col("types"))).alias("parameterizable"))


def renamed_variables(uses: DataFrame) -> DataFrame:
    """pair, v1, v2, uses, renamed: variables that stand in the same places of two mapped fragments (pair, v1, v2: a row a place).

    A renaming is one to one: wherever v1 stands the other side has v2, and wherever v2 stands the first has v1. Names that
    stand against several others, and what stands against these, conflict and stay differences; equal names are no renaming.
    """
    n = uses.filter("v1 IS NOT NULL AND v2 IS NOT NULL").groupBy("pair", "v1", "v2").agg(F.count(F.lit(1)).alias("uses"))
    alone = lambda v: F.count(F.lit(1)).over(W.partitionBy("pair", v)) == 1
    return n.withColumn("renamed", alone("v1") & alone("v2") & (F.col("v1") != F.col("v2")))


def movable(statements: DataFrame, edges: DataFrame) -> DataFrame:
    """g, node, before, after: where statements that aren't mapped can move, past all that are.

    statements: g, node, mapped. edges: g, src, dst: dst depends on src (control, data, anti or output; loop-carried ones left
    out). A statement can move before the mapped ones unless it depends on one, itself or through others that aren't mapped, and
    after them unless one depends on it.
    """
    kept = settled(statements.select("g", "node", F.coalesce("mapped", F.lit(False)).alias("mapped")))
    e = settled(edges.select("g", "src", "dst").filter("src <> dst").distinct())
    free = settled(kept.filter("NOT mapped").select("g", "node"))
    fixed = kept.filter("mapped").select("g", "node")

    def tied(start: str, end: str) -> DataFrame:
        """Free statements at the end of a path that starts at a fixed one and passes free ones alone."""
        inner = settled(e.join(free.withColumnRenamed("node", end), ["g", end], "left_semi"))
        first = inner.join(fixed.withColumnRenamed("node", start), ["g", start], "left_semi").select("g", F.col(end).alias("node"))
        return settled(reached(first, steps_by(inner.select("g", F.col(start).alias("node"), F.col(end).alias("next")), "g"), "g"))

    down, up = tied("src", "dst"), tied("dst", "src")
    mark = lambda x, name: x.withColumn(name, F.lit(False))
    out = free.join(mark(down, "before"), ["g", "node"], "left").join(mark(up, "after"), ["g", "node"], "left")
    return out.select("g", "node", F.coalesce("before", F.lit(True)).alias("before"), F.coalesce("after", F.lit(True)).alias("after"))
