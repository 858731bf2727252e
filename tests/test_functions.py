"""Functions on hand-computed cases."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import edits, names, sets


def one(spark, *cols):
    return spark.range(1).select(*cols).collect()[0]


def arr(*x):
    return F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")


def test_jaccard_distance(spark):
    d = sets.jaccard_distance
    r = one(spark, d(arr("a", "b", "c"), arr("b", "c", "d")), d(arr(), arr()), d(arr("a"), arr()), d(arr("a"), arr("a")))
    assert tuple(r) == (0.5, 1.0, 1.0, 0.0)


def test_common_counts(spark):
    """Pairs that share many elements travel as lists: no join, and no row for each element that two keys share."""
    rng = random.Random(5)
    rows = [(rng.randint(1, 9), rng.randint(1, 12)) for _ in range(80)] + [(3, None), (4, None), (None, 5)]
    x = spark.createDataFrame(rows, "s int, p int")
    of = {}
    for s, p in rows:
        if s is not None and p is not None:
            of.setdefault(s, set()).add(p)
    out = sets.common_counts(x, "s", "p")
    want = {(a, b): len(of[a] & of[b]) for a in of for b in of if a < b and of[a] & of[b]}
    assert {(r["a"], r["b"]): r["common"] for r in out.collect()} == want
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_set_algebra(spark):
    a, b = arr("x", "y"), arr("y", "z")
    r = one(spark, F.array_sort(sets.union(a, b)), sets.intersection(a, b), sets.difference(a, b), sets.contains_all(a, arr("x")), sets.contains_all(a, b))
    assert tuple(r) == (["x", "y", "z"], ["y"], ["x"], True, False)
    x = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert sets.union_rows(x, x).count() == 2 and sets.union_rows(x, x, bag=True).count() == 6


def test_slice_measures(spark):
    s = F.array(arr(1, 2, 3), arr(2, 3, 4, 5))
    m = sets.slice_measures(s, F.lit(10))
    r = one(spark, *m.values())
    assert tuple(r) == pytest.approx((0.2, 0.35, 0.5833333333333333))


def test_names(spark):
    r = one(
        spark, names.identifier_words(F.lit("parseOrder")), names.identifier_words(F.lit("total_order2")), names.identifier_words(F.lit("XMLReader")), names.owner_of(F.lit("a.B::int x")), names.member_of(F.lit("a.B::int x")),
        names.method_id(F.lit("a.B"), F.lit("f"), arr("int", "c.D"), F.lit("void")), names.method_id(F.lit("a.B"), F.lit("B"), arr(), F.lit(None)), names.attribute_id(F.lit("a.B"), F.lit("int"), F.lit("x")),
    )
    assert list(r) == [["parse", "order"], ["total", "order"], ["xml", "reader"], "a.B", "int x", "a.B::f(int, c.D):void", "B()", "a.B::int x"]


def test_types(spark):
    p = lambda t: names.type_parts(F.lit(t))
    r = one(spark, p("java.util.Map<K, java.util.List<V>>[][]"), p("int"), names.same_type(p("a.B<T>"), p("a.B<x.Y>")), names.same_type(p("a.B"), p("a.C")), names.same_type(p("T"), p("a.C")), names.same_type(p("a.B[]"), p("a.B")))
    assert tuple(r[0]) == ("java.util.Map", "<K, java.util.List<V>>", 2) and tuple(r[1]) == ("int", None, 0)
    assert list(r)[2:] == [True, False, True, False]


def test_paths(spark):
    p = arr("a", "b", "c")
    r = one(spark, names.path_starts_with(p, arr("a", "b")), names.path_starts_with(p, arr("b")), names.path_left(p), names.path_right(p), names.path_final(p), names.path_contains(p, F.lit("b")))
    assert list(r) == [True, False, ["a", "b"], ["b", "c"], "c", True]


def test_small_functions(spark):
    r = one(spark, names.normal_path(F.lit("a\\b//c")), names.hexadecimal(F.lit("1f")), names.depth(F.lit("a.b.c")), names.shift_status(F.lit(3), F.lit(-1)), names.shift_status(F.lit(3), F.lit(3)), names.shift_status(F.lit(3), F.lit(4)), names.extracted_name(F.lit("a.B"), arr("BProduct")), names.extracted_name(F.lit("a.B"), arr()))
    assert list(r) == ["a/b/c", 31, 2, "tampered", "original", "shifted", "BProduct2", "BProduct"]
    rows = [x["s"] for x in spark.range(8).select(names.severity(F.col("id")).alias("s")).collect()]
    assert rows == [1, 1, 2, 3, 3, 4, 4, 5]
    r = one(spark, names.is_generated(arr("/* Generated from x.g by ANTLR 2 */")), names.is_generated(arr("hand made")), names.is_well_known(F.lit("hashCode"), arr(), F.lit("int")), names.is_well_known(F.lit("hashCode"), arr("int"), F.lit("int")))
    assert list(r) == [True, False, True, False]


def test_version_order(spark):
    v = ["1.10", "1.9", "1.9-beta", "2", "1.9.1", "10"]
    got = [r["v"] for r in spark.createDataFrame([(x,) for x in v], "v string").orderBy(names.version_key(F.col("v"))).collect()]
    assert got == ["1.9", "1.9.1", "1.9-beta", "1.10", "2", "10"]


def test_list_distance(spark):
    assert edits.list_distance(list("abc"), list("axcd")) == 2 and edits.list_distance([], ["a"]) == 1 and edits.list_distance([], []) == 0
    r = random.Random(0)
    for _ in range(200):
        a, b, c = ([r.choice("ab") for _ in range(r.randint(0, 6))] for _ in range(3))
        d = edits.list_distance
        assert d(a, b) == d(b, a) and d(a, c) <= d(a, b) + d(b, c) and (d(a, b) == 0) == (a == b)
    x = one(spark, edits.token_distance(arr("a", "b", "c"), arr("a", "x", "c", "d")), edits.token_distance(F.lit(None).cast("array<string>"), arr("a")), edits.char_distance(F.lit("é"), F.lit("e")))
    assert list(x) == [2, None, 1]


#: Published pairs of words and their stems.
STEMS = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "sized": "size", "hopping": "hop",
    "falling": "fall", "hissing": "hiss", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "valenci": "valenc", "digitizer": "digit", "operator": "oper", "feudalism": "feudal", "hopefulness": "hope",
    "triplicate": "triplic", "formative": "form", "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "effective": "effect",
    "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "at": "at",
}


def test_stems(spark):
    assert {w: edits.stem(w) for w in STEMS} == STEMS
    assert one(spark, edits.stems(arr("orders", "total")))[0] == ["order", "total"]


def test_text_diff(spark):
    d = edits.text_diff(F.lit("one two\nx"), F.lit("one too\nx"))
    df = spark.range(1).select(d.alias("d"))
    r = df.select("d", edits.patch(F.lit("one two\nx"), F.col("d")).alias("new"), edits.patch(F.lit("other"), F.col("d")).alias("no")).collect()[0]
    assert "".join(x["text"] for x in r["d"] if x["op"] != "insert") == "one two\nx" and r["new"] == "one too\nx" and r["no"] is None
    lines = one(spark, edits.text_diff(F.lit("a\nb\n"), F.lit("a\nc\n"), lines=True))[0]
    assert [tuple(x) for x in lines] == [("equal", "a\n"), ("delete", "b\n"), ("insert", "c\n")]
