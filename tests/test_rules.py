"""The detectors' rules on cases in which each rule alone stands against a candidate."""

import random

from pyspark.sql import functions as F

from factloom.operators import rules


def broken(row, names):
    return {n for n in names if row[n]}


def test_move_method(spark):
    cases = ["ok", "is_synchronized", "calls_super", "overrides", "writes_own_field", "no_target_object", "one_to_many", "assigns_target_parameter", "passes_this", "signature_in_target", "checks_target_for_null"]
    methods = [(c, "S", c, "int", ["T", "long"], [], c == "is_synchronized", c == "overrides") for c in cases]
    methods += [("t", "T", "signature_in_target", "int", ["long"], [], False, False), ("u", "T", "ok", "void", ["long"], [], False, False), ("v", "T", "ok", "int", ["int"], [], False, False)]
    methods += [("m_i", "S", "m_i", "int", [], [], False, False), ("m_e", "S", "m_e", "int", [], [], False, False), ("m_t", "Tests", "m_t", "int", [], ["org.junit.Test"], False, False), ("m_x", "Old", "m_x", "int", [], [], False, False)]
    m = spark.createDataFrame(methods, "method string, class string, name string, return_type string, params array<string>, annotations array<string>, is_synchronized boolean, overrides boolean")
    classes = spark.createDataFrame([("S", "class", None), ("T", "class", None), ("I", "interface", None), ("E", "enum", None), ("Tests", "class", None), ("Old", "class", "junit.framework.TestCase")], "class string, kind string, superclass string")
    body = spark.createDataFrame(
        [("calls_super", "super field", "x", None), ("writes_own_field", "own field write", "x", None), ("assigns_target_parameter", "parameter write", "p", "T"), ("passes_this", "argument", "this", None), ("checks_target_for_null", "null check", "p", "T"),
         ("one_to_many", "field", "S::f", None), ("ok", "field", "S::g", None), ("ok", "argument", "that", None), ("ok", "null check", "p", "I"), ("ok", "parameter write", "p", "E")],
        "method string, kind string, name string, type string",
    )
    cand = spark.createDataFrame([(c, "S", "T") for c in cases] + [("m_i", "S", "I"), ("m_e", "S", "E"), ("m_t", "Tests", "T"), ("m_x", "Old", "T")], "method string, source string, target string")
    reach = cand.filter("method <> 'no_target_object'").select("method", "target")
    none = spark.createDataFrame([], "method string, target string")
    assoc = spark.createDataFrame([("S", "T", "S::f", True), ("S", "T", "S::g", False)], "from_class string, to_class string, field string, is_container boolean")
    out = {r["method"]: r for r in rules.move_method_rules(cand, m, classes, body, reach, none, assoc).collect()}
    assert len(out) == len(cases) + 4 and all(r["applicable"] == (not broken(r, rules.MOVE_METHOD)) for r in out.values())
    for c in cases:
        assert broken(out[c], rules.MOVE_METHOD) == ({c} - {"ok"}), c
    assert [broken(out[k], rules.MOVE_METHOD) for k in ("m_i", "m_e", "m_t", "m_x")] == [{"target_is_interface"}, {"target_is_enum"}, {"source_is_test"}, {"source_is_test"}]


def test_signatures_meet_whole(spark):
    """Methods of one name and type in the target are met by their parameters too, never in pairs: no join has other keys."""
    m = spark.range(40).selectExpr("concat('m', id) AS method", "if(id < 20, 'S', 'T') AS class", "concat('f', id % 1) AS name", "concat('int', id % 1) AS return_type", "if(id < 20, array(concat('p', id), 'T'), array(concat('p', id - 20 + id % 2 * 50))) AS params", "cast(array() AS array<string>) AS annotations", "false AS is_synchronized", "false AS overrides")
    cand = m.filter("class = 'S'").selectExpr("method", "class AS source", "'T' AS target")
    classes = spark.createDataFrame([("S", "class", None), ("T", "class", None)], "class string, kind string, superclass string")
    none = spark.createDataFrame([], "method string, target string")
    assoc = spark.createDataFrame([], "from_class string, to_class string, field string, is_container boolean")
    out = rules.move_method_rules(cand, m, classes, spark.createDataFrame([], "method string, kind string, name string, type string"), cand.select("method", "target"), none, assoc)
    assert {r["method"] for r in out.filter("signature_in_target").collect()} == {f"m{k}" for k in range(0, 20, 2)}
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x and "return_type" in x and "name" in x]
    assert joins and all("LeftSemi" in x and "other" in x for x in joins)


def test_extract_class(spark):
    schema = "class string, entity string, kind string, access string, is_static boolean, is_abstract boolean, is_synchronized boolean, overrides boolean, calls_super boolean, reads_enclosing boolean, is_accessor boolean, is_delegate boolean, name string, params array<string>, return_type string"
    plain = {"class": "A", "access": "private", "is_static": False, "is_abstract": False, "is_synchronized": False, "overrides": False, "calls_super": False, "reads_enclosing": False, "is_accessor": False, "is_delegate": False, "params": [], "return_type": "int"}
    row = lambda e, kind, **k: {**plain, "entity": e, "kind": kind, "name": e, **k}
    ents = [row(e, "method") for e in ("m1", "m2", "m3")] + [row(e, "field") for e in ("x", "y", "z", "w")] + [row("bad", "method", overrides=True), row("ro", "method", name="readObject", params=["java.io.ObjectInputStream"], return_type="void"), row("pub", "field", access="public")]
    ents += [row("b1", "method", **{"class": "B"}), row("bx", "field", **{"class": "B"}), row("by", "field", **{"class": "B"}), row("eq", "method", name="equals", params=["java.lang.Object"], return_type="boolean", **{"class": "B"}), row("bs", "field", is_static=True, **{"class": "B"})]
    e = spark.createDataFrame([tuple(r[f.split()[0]] for f in schema.split(", ")) for r in ents], schema)
    acc = spark.createDataFrame([("m1", "x", "A"), ("m1", "y", "A"), ("bad", "x", "A"), ("ro", "x", "A"), ("m2", "pub", "A"), ("q", "pub", "Q"), ("q", "x", "Q"), ("b1", "bx", "B"), ("b1", "by", "B")], "src string, dst string, src_class string")
    cand = {"good": "m1 x y", "banned_method": "m1 bad x y", "serial": "m1 ro x", "visible_field_used_outside": "m2 m1 pub", "too_small": "m1 x", "no_method": "x y z", "field_not_accessed": "m1 x z"}
    rows = [(c, "A", x) for c, xs in cand.items() for x in xs.split()] + [("rest", "B", x) for x in ("b1", "bx", "by")]
    out = {r["candidate"]: broken(r, rules.EXTRACT_CLASS) for r in rules.extract_class_rules(spark.createDataFrame(rows, "candidate string, class string, entity string"), e, acc).collect()}
    assert out == {"good": set(), "banned_method": {"banned_method"}, "serial": {"banned_method"}, "visible_field_used_outside": {"visible_field_used_outside"}, "too_small": {"too_small"}, "no_method": {"no_method", "field_not_accessed"}, "field_not_accessed": {"field_not_accessed"}, "rest": {"no_method_remains", "no_field_remains"}}


NODES = "method string, node int, kind string, loop int, declares array<string>, closes array<string>, creates array<string>, touches array<string>, defines array<struct<name:string,is_field:boolean,composite:boolean>>"


SLICES = [
    (None, {}), ("whole_body", {"size": 4}), ("lone_criterion", {"members": {1, 2}}), ("declaration_duplicated", {"kept": {1}}), ("variable_returned", {"returned": ["v"]}),
    ("criteria_alone", {"criteria": {1, 2, 3, 4}}), ("criteria_duplicated", {"kept": {2}}), ("exit_depends", {"edges": [(4, 7, "control", None), (7, 9, "control", None)]}), ("holds_exit", {"kind": {4: "exit"}}),
    ("duplicated_state_change", {"kept": {4}, "defines": {4: [("f", True, False)]}}), ("anti_dependence", {"edges": [(8, 3, "anti", "a")]}), ("output_dependence", {"edges": [(8, 3, "output", "a")]}),
    ("duplicated_creation", {"kept": {4}, "creates": {4: ["o"]}, "touches": {2: ["o"]}, "edges": [(4, 2, "data", "o")]}), ("over_thresholds", {"size": 3}), ("branch_without_loop", {"kind": {4: "break"}, "loop": {4: 6}}),
    ("criterion_closed", {"kind": {4: "try"}, "closes": {4: ["v"]}}), ("declaration_closed", {"kind": {4: "try"}, "closes": {4: ["u"]}, "declares": {3: ["u"]}}),
    ("none: data feeds the anti-dependent node", {"edges": [(8, 3, "anti", "a"), (7, 8, "data", "a")]}), ("none: out of the region", {"edges": [(6, 3, "output", "a")]}), ("none: loop inside", {"kind": {4: "break"}, "loop": {4: 3}}),
]


def test_slice(spark):
    """Each case is a method of nine nodes with one slice."""
    nodes, members, region, edges, slices, returned = ([] for _ in range(6))
    for i, (_, changes) in enumerate(SLICES):
        get = lambda k, n, other, changes=changes: changes.get(k, {}).get(n, other)
        m, declares = f"m{i}", {1: ["v"], **changes.get("declares", {})}
        nodes += [(m, n, get("kind", n, "exit" if n == 9 else "statement"), get("loop", n, None), declares.get(n, []), get("closes", n, []), get("creates", n, []), get("touches", n, []), get("defines", n, [])) for n in range(1, 10)]
        kept, criteria = changes.get("kept", set()), changes.get("criteria", {2})
        members += [(i, n, n in criteria, n not in kept, n in kept) for n in changes.get("members", {1, 2, 3, 4})]
        region += [(i, n) for n in (1, 2, 3, 4, 7, 8)]
        edges += [(m, *e) for e in changes.get("edges", [])]
        slices.append((i, m, "v", changes.get("size", 9)))
        returned += [(m, v) for v in changes.get("returned", [])]
    df = spark.createDataFrame
    out = rules.slice_rules(
        df(slices, "slice int, method string, variable string, method_size int"), df(members, "slice int, node int, criterion boolean, removable boolean, indispensable boolean"), df(nodes, NODES),
        df(edges, "method string, src int, dst int, dep string, variable string"), df(region, "slice int, node int"), df(returned, "method string, variable string"),
    )
    got = {r["slice"]: r for r in out.collect()}
    also = {"holds_exit": {"exit_depends"}, "criterion_closed": {"declaration_closed"}}
    assert len(got) == len(SLICES)
    for i, (rule, _) in enumerate(SLICES):
        want = set() if rule is None or rule.startswith("none") else {rule}
        assert broken(got[i], rules.SLICE) == want | also.get(rule, set()), rule
        assert got[i]["applicable"] == (not want), rule


def test_small_rules(spark):
    got = lambda df: sorted(tuple(r) for r in df.collect())
    assert got(rules.envied_elements(spark.createDataFrame([("e", "T", "T", "a"), ("e", "T", "T", "a"), ("e", "T", "S", "b"), ("f", "T", "S", "b")], "entity string, target string, owner string, member string"))) == [("e", "T", 1), ("f", "T", 0)]
    m = [("A", "method", "f", "public", False), ("A", "method", "main", "public", False), ("A", "constructor", "A", "public", False), ("A", "field", "main", "", False), ("A", "field", "x", "private", False), ("A", "field", "y", "public", True)]
    assert got(rules.accessible_members(spark.createDataFrame(m, "class string, kind string, name string, access string, is_static boolean"))) == [("A", 2)]
    assert got(rules.id_shift(spark.createDataFrame([(1, 5, 11), (1, 6, 14), (1, 9, 13)], "g int, a int, b int"), ["g"])) == [(1, 0 + 2 + 2)]
    cases = spark.createDataFrame([("c", False, 2), ("c", False, 3), ("c", True, 0), ("d", False, 0), ("d", True, 4)], "candidate string, is_default boolean, statements int")
    assert got(rules.statements_per_case(cases)) == [("c", 2.5, False), ("d", 2.0, True)]
    assert got(rules.linked_blocks(spark.createDataFrame([("m", 1, 10), ("m", 2, 11), ("n", 1, 20)], "g string, o int, b int"), "g", "o", "b").select("b", F.coalesce("before", F.lit(0)), F.coalesce("after", F.lit(0)))) == [(10, 0, 11), (11, 10, 0), (20, 0, 0)]
    assert got(rules.first_and_last(spark.createDataFrame([("v", 3, "def"), ("v", 1, "use"), ("v", 5, "def"), ("v", 4, "use")], "v string, node int, mode string"), ["v"])) == [("v", 3, 4)]
    c = spark.createDataFrame([("a", 1, 4), ("a", 0, 2), ("a", 0, 3), ("b", 1, 9)], "g string, source_deps int, extracted_deps int")
    assert got(rules.best_of_groups(c, "g")) == [("a", 0, 3), ("b", 1, 9)]
    s = spark.createDataFrame([("s", 2, "+"), ("s", 1, "a"), ("s", 3, "b")], "s string, position int, token string")
    assert got(rules.unified_text(s, ["s"])) == [("s", "a + b")]
    k = spark.createDataFrame([("m", "if"), ("m", "if"), ("m", "for")], "m string, kind string")
    assert got(rules.statement_counts(k, ["m"])) == [("m", "for", 1, 3), ("m", "if", 2, 3)] and rules.of_kind(k, "for").count() == 1


def test_extract_class_counts_shuffle_once(spark):
    """Rows dealt by class stay where they are; the counts are those of the detector's own joins."""
    from factloom.operators import candidates

    r = random.Random(5)
    parts = sorted({(c, f"{c}#{r.randint(0, 3)}", e, e[0]) for c in range(30) for _ in range(24) for e in (f"m{c}_{r.randint(0, 5)}", f"f{c}_{r.randint(0, 7)}")})
    uses = sorted({(f"m{c}_{r.randint(0, 5)}", f"f{c}_{r.randint(0, 9)}", c) for c in range(30) for _ in range(9)})
    homes = sorted({(c, e) for c, _, e, _ in parts} | {(c, e) for m, f, c in uses for e in (m, f)})
    rows = [(c, e, k, None, 0) for c, k, e, _ in parts] + [(c, m, None, f, 0) for m, f, c in uses] + [(c, e, None, None, rules.KNOWN | (rules.METHOD if e[0] == "m" else 0)) for c, e in homes]
    said = spark.createDataFrame(rows, "class long, entity string, candidate string, dst string, marks int")
    n = rules.extract_class_counts(said.repartition(3, "class"))
    assert n._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    p = spark.createDataFrame(parts, "class long, candidate string, entity string, kind string").withColumn("kind", F.when(F.col("kind") == "m", "method").otherwise("field"))
    judged = p.select("candidate", F.lit(True).alias("applicable")).distinct()
    want = candidates.detected_extract_classes(p, spark.createDataFrame(uses, "src string, dst string, class long"), spark.createDataFrame(homes, "class long, entity string"), judged)
    got = sorted(tuple(x) for x in candidates.ranked_extract_classes(n).collect())
    assert got == sorted(tuple(x) for x in want.collect()) and len(got) > 5
    bests = {x[0]: x[5] for x in got}
    assert sorted(bests.values()) == list(range(1, len(bests) + 1))
