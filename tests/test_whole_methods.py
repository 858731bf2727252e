"""Rules of object-state slices of methods that are a row each, against the same by tables of nodes."""

from pyspark.sql import functions as F

from factloom.operators import slices
from factloom.plans import slice_queries


def test_whole_methods_equal_tables_of_nodes(spark, small):
    heads, state, nodes, variables, edges, region = slice_queries._facts(spark, small)
    members = slices.object_slices(heads, state, nodes, variables, edges, region)
    returned = nodes.filter("kind = 'exit'").select("method", F.explode("owner").alias("variable"))
    sizes = nodes.groupBy("method").agg(F.count(F.lit(1)).alias("method_size"))
    columns = ["method", "variable", "block", *slices.OBJECT_SLICE, "applicable"]
    want = slices.object_slice_rules(heads, members, sizes, nodes, edges, region, returned, slice_queries.T).withColumn("block", F.col("slice.block")).select(*columns)
    got = slice_queries.object_slice_rules(spark, small).select(*columns)
    assert want.count() and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_events_are_dealt_once(spark, small):
    plan = slice_queries.object_slice_rules(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_method_without_changes_has_no_slice(spark):
    schema = """method long, nodes array<struct<node: long, kind: string, loop: long, blocks: array<long>, changes: array<string>, uses: array<string>, declares: array<string>, renews: array<string>,
        closes: array<string>, creates: array<string>, touches: array<string>, defines: array<struct<name: string, is_field: boolean, composite: boolean>>>>,
        edges array<struct<src: long, dst: long, dep: string, variable: string>>, fields array<string>, parameters array<string>, returned array<string>"""
    node = lambda n, changes: (n, None, None, [0], changes, None, None, None, None, None, None, None)
    rows = [(1, [node(1, [])], [], [], [], []), (2, [node(1, ["a", None]), node(2, None)], [(0, 1, "control", None), (1, 2, "data", "a"), (7, 9, "data", None)], None, None, None)]
    got = slices.whole_method_rules(spark.createDataFrame(rows, schema)).collect()
    assert [(r["method"], r["variable"], r["block"], r["minimum_size"]) for r in got] == [(2, "a", 0, True)]
