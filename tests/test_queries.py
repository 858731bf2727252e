"""Every registered query against its SQL, plans without Python or products where none is needed, and the contract."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from factloom.plans import catalogue


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def shown(v):
    return "" if v is None or v != v else f"{v:.5f}" if isinstance(v, float) else str(v)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(shown(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, small, duck, name):
    df = entry.queries()[name](spark, small)
    want = duck.sql(entry.oracle_sql()[name])
    assert normal(df.columns, [tuple(r) for r in df.collect()]) == normal(want.columns, want.fetchall())


#: Queries that need a kernel in Python.
KERNELS = {"token_edit_distance", "stemmed_topics", "hier_clusters"}
#: Queries whose rounds SQL has no form for; tests hold their operators against brute force.
ROUNDS = {"mapped_orders", "tree_matches", "ranked_tree_matches", "mapped_statements"}


@pytest.mark.parametrize("name", ["jaccard_supplier_pairs", "lcom2_by_class", "envy_candidates", "near_clone_pairs", "subclone_groups", "interval_innermost", "reaching_defs", "access_map"])
def test_plans(spark, small, name):
    df = catalogue.queries()[name](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert "ReadSchema" in plan


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    missing = set(catalogue.queries()) - set(catalogue.oracle_sql())
    assert missing == KERNELS | ROUNDS
    for name in missing:
        assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() >= 0
