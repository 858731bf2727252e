"""Pairs of methods that share a field, counted by blocks, against all pairs."""

import itertools
import random

import numpy as np

from factloom.operators import metrics
from factloom.plans import catalogue


def test_bits_equal_all_pairs():
    r = random.Random(5)
    for wide, room in ((64, 64), (64, 1 << 12), (16384, 1 << 25)):
        sets = [set(r.sample(range(30), r.randint(1, 5))) for _ in range(200)]
        row = np.repeat(np.arange(200), [len(s) for s in sets])
        code = np.array([c for s in sets for c in s])
        left = np.array([r.random() < 0.5 for _ in sets])
        for right in (left, ~left):
            want = sum(bool(sets[i] & sets[j]) for i in np.flatnonzero(left) for j in np.flatnonzero(right))
            assert metrics.shared_bits(row, code, left, right, wide, room) == want


def test_connectivity_equals_all_pairs_with_calls_and_nulls(spark):
    r = random.Random(6)
    uses = [(c, m, r.choice(["f%d" % r.randint(0, 40), None])) for c in "ab" for m in range(60) for _ in range(2)]
    calls = [(c, r.randint(0, 59), r.randint(0, 59)) for c in "ab" for _ in range(80)]
    u, k = spark.createDataFrame(uses, "class string, method int, field string"), spark.createDataFrame(calls, "class string, caller int, callee int")
    for block in (7, 200_000):
        got = {x["class"]: x["c"] for x in metrics.sharing_pairs(u.dropna().distinct(), block).collect()}
        of = {(c, m): {f for d, n, f in uses if (d, n) == (c, m)} - {None} for c in "ab" for m in range(60)}
        shared = {c: {p for p in itertools.combinations(range(60), 2) if of[c, p[0]] & of[c, p[1]]} for c in "ab"}
        assert got == {c: len(p) for c, p in shared.items()}
    whole = {c: p | {(min(a, b), max(a, b)) for d, a, b in calls if d == c and a != b} for c, p in shared.items()}
    got = {x["class"]: x["connectivity"] for x in metrics.connectivity(u, u, k).collect()}
    assert all(abs(got[c] - 2 * len(whole[c]) / (60 * 59)) < 1e-9 for c in "ab")


def test_connectivity_makes_no_pairs_as_rows(spark, small):
    plan = catalogue.connectivity_by_class(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "< other" not in plan
