"""Tables of rounds are merged, not broadcast by their packed size; what is reached, against a plain walk."""

import random

from pyspark.sql import functions as F

from factloom.operators import graph
from factloom.plans import slice_queries, tree_queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_of_rounds_are_not_broadcast(spark):
    t = graph.settled(spark.range(1000).select(F.lit(1).alias("g"), F.col("id").alias("node")))
    r = graph.Rounds(t)
    for other in (t, r.known, r.new):
        assert "Broadcast" not in plan(t.join(other.select("g", F.col("node").alias("node")), ["g", "node"]))


def test_movable_statements_sends_nothing_to_the_driver(spark, small):
    assert "Broadcast" not in plan(tree_queries.movable_statements(spark, small))


def test_statements_of_trees_are_merged(spark, small):
    assert "Broadcast" not in plan(tree_queries._statements(spark, small))


def test_object_slices_send_nothing_to_the_driver(spark, small):
    for query in (slice_queries.object_slices, slice_queries.passed_parameters):
        assert "Broadcast" not in plan(query(spark, small))


def test_reached_equals_a_plain_walk(spark):
    r = random.Random(3)
    steps = [(g, r.randint(-2, 9), r.randint(-2, 9)) for g in range(40) for _ in range(r.randint(0, 12))]
    starts = [(g, r.randint(-2, 9)) for g in range(40) for _ in range(r.randint(0, 2))]
    want = set()
    todo = list(starts)
    while todo:
        at = todo.pop()
        if at not in want:
            want.add(at)
            todo += [(g, d) for g, s, d in steps if (g, s) == at]
    e = spark.createDataFrame([((f"m{g}", g), s, d) for g, s, d in steps], "slice struct<method:string,k:int>, node int, next int").repartition(2)
    b = spark.createDataFrame([((f"m{g}", g), n) for g, n in starts] * 2, "slice struct<method:string,k:int>, node int")
    for rows in (1, 3, 256):
        got = graph.reached(b, graph.steps_by(e, "slice"), "slice", rows)
        assert got.schema["node"].dataType.simpleString() == "int"
        assert sorted((x["slice"]["k"], x["node"]) for x in got.collect()) == sorted(want)
