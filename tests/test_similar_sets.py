"""Similar sets against all pairs, and how copies are met."""

import itertools
import random

from factloom.operators import clones


def test_similar_sets_equal_all_pairs_with_copies(spark):
    r = random.Random(8)
    sets = [set(r.sample(range(25), r.randint(1, 12))) for _ in range(60)]
    sets += [set(r.choice(sets)) ^ ({r.randint(0, 24)} if r.random() < 0.6 else set()) or {1} for _ in range(80)]
    order = r.sample(range(140), 140)
    rows = [("g%d" % (k % 2), k, "w%d" % e) for k, s in zip(order, sets, strict=True) for e in s] * 2
    df = spark.createDataFrame(rows, "g string, k int, e string")
    of = dict(zip(order, sets, strict=True))
    for similarity in (0.5, 0.8, 1.0):
        want = {(a, b, len(of[a] & of[b])) for a, b in itertools.combinations(range(140), 2) if a % 2 == b % 2 and len(of[a] & of[b]) >= similarity * len(of[a] | of[b]) - 1e-9}
        got = [(x["a"], x["b"], x["common"]) for x in clones.similar_sets(df, "k", "e", similarity, ["g"]).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_copies_are_compared_once(spark):
    df = spark.createDataFrame([(k, e) for k in range(50) for e in range(10)], "k int, e int")
    got = clones.similar_sets(df, "k", "e", 0.8)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert got.count() == 50 * 49 // 2 and "array_intersect" in plan


def test_similar_arrays_equal_all_pairs_and_carry_marks(spark):
    r = random.Random(5)
    sets = [set(r.sample(range(25), r.randint(1, 12))) for _ in range(60)]
    sets += [set(r.choice(sets)) ^ ({r.randint(0, 24)} if r.random() < 0.6 else set()) or {1} for _ in range(80)]
    rows = [("g%d" % (k % 2), k, [f"w{e}" for e in s] * 2 + [None]) for k, s in enumerate(sets)] + [("g0", 998, []), ("g0", 999, None), (None, 1, ["w1"])]
    # A key whose elements come in two rows.
    rows[0] = ("g0", 0, [f"w{e}" for e in sets[0]][:1])
    rows.append(("g0", 0, [f"w{e}" for e in sets[0]]))
    df = spark.createDataFrame(rows, "g string, k int, s array<string>")
    marks = df.selectExpr("g", "k", "concat(k, 'm') AS mark").distinct()
    for similarity in (0.5, 0.8):
        want = {(a, b, len(sets[a] & sets[b]), f"{a}m", f"{b}m") for a, b in itertools.combinations(range(140), 2) if a % 2 == b % 2 and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9}
        got = [(x["a"], x["b"], x["common"], x["mark_a"], x["mark_b"]) for x in clones.similar_arrays(df, "k", "s", similarity, ["g"], marks).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_sets_are_sent_once_for_a_group_of_pairs(spark, monkeypatch):
    """Of 40 like sets each meets 39 others; a pair once carried both. Small parts give the same pairs."""
    df = spark.createDataFrame([(k, [f"w{e}" for e in range(60) if e != k]) for k in range(40)], "k int, s array<string>")
    want = {(a, b, 58) for a, b in itertools.combinations(range(40), 2)}
    for side in (512, 7):
        monkeypatch.setattr(clones, "SIDE", side)
        got = clones.similar_arrays(df, "k", "s", 0.8)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert {(x["a"], x["b"], x["common"]) for x in got.collect()} == want and "array_intersect" not in plan
