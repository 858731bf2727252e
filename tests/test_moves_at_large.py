"""Moved methods from orders that are dealt once, and ranks from ranges."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import candidates
from factloom.plans import detector_queries, rule_queries


@pytest.mark.parametrize("n", [0, 1, 300])
def test_ranks_by_ranges_are_those_of_one_order(spark, n):
    rows = [("s%d" % (k % 4), k, "t%d" % (k % 7), k % 3, k % 11) for k in range(n)]
    df = spark.createDataFrame(rows, "source string, entity long, target string, source_deps long, target_deps long")
    want, got = candidates.ranked(df), candidates.ranked(df, tasks=5)
    assert got.dtypes == want.dtypes and sorted(got.collect()) == sorted(want.collect())


def test_moves_equal_the_detector_over_all_rules(spark, small):
    lines = rule_queries._lines(spark, small).select(F.col("method").alias("entity"), "source", F.col("target").alias("owner"), F.col("part").alias("member"))
    judged = rule_queries.move_method_rules(spark, small).select("method", "target", "applicable")
    want = candidates.detected_move_methods(lines, judged).collect()
    got = detector_queries.detected_move_methods(spark, small).collect()
    assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_unknown_priority_is_not_applicable(spark, small, tmp_path):
    """NOT (NULL OR ...) isn't true in SQL."""
    for name in ("customer", "supplier", "part", "nation", "lineitem"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{small}/{name}.parquet")
    spark.read.parquet(f"{small}/orders.parquet").withColumn("o_orderpriority", F.lit(None).cast("string")).write.parquet(str(tmp_path / "orders.parquet"))
    assert detector_queries.detected_move_methods(spark, str(tmp_path)).count() == 0
