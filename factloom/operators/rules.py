"""The detectors' rules, computed from fact tables: one boolean column for each rule, true where it holds against a candidate.

Every rule is a count or a flag of the facts of a method, class or slice, added up before it meets the candidates, so a
candidate costs what its own facts do. Facts that are absent break no rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.names import is_well_known
from .facts import Thresholds, is_test
from .graph import Rounds

#: What stands against moving a method to a target.
MOVE_METHOD = (
    "is_synchronized", "calls_super", "overrides", "writes_own_field", "target_is_interface", "no_target_object", "one_to_many",
    "assigns_target_parameter", "passes_this", "target_is_enum", "source_is_test", "signature_in_target", "checks_target_for_null",
)
#: What stands against extracting a class.
EXTRACT_CLASS = ("banned_method", "visible_field_used_outside", "too_small", "no_method", "no_method_remains", "no_field_remains", "field_not_accessed")
#: What stands against extracting a slice.
SLICE = (
    "whole_body", "lone_criterion", "declaration_duplicated", "variable_returned", "criteria_alone", "criteria_duplicated", "exit_depends", "holds_exit",
    "duplicated_state_change", "anti_dependence", "output_dependence", "duplicated_creation", "over_thresholds", "branch_without_loop", "criterion_closed", "declaration_closed",
)


def _any(condition: Column, name: str) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False)).alias(name)


def _decided(df: DataFrame, rules: tuple[str, ...]) -> DataFrame:
    """With absent flags as false, and `applicable` where no rule stands against the row."""
    df = df.fillna(False, list(rules))
    none = ~F.greatest(*(F.col(r) for r in rules))
    return df.withColumn("applicable", none)


def move_method_rules(candidates: DataFrame, methods: DataFrame, classes: DataFrame, body: DataFrame, reachable: DataFrame, local_types: DataFrame, associations: DataFrame) -> DataFrame:
    """candidates (method, source, target) with MOVE_METHOD and `applicable`.

    methods: method, class, name, return_type, params, annotations, is_synchronized, overrides. classes: class, kind,
    superclass. body: method, kind, name, type, where kind is 'super call', 'super field', 'own field write', 'parameter write'
    (of the type), 'argument' (named this), 'null check' (of a parameter or field of the type), or 'field' (its id).
    reachable, local_types: method, target. associations: from_class, to_class, field, is_container.
    """
    kind = F.col("kind")
    own = body.groupBy("method").agg(_any(kind.isin("super call", "super field"), "calls_super"), _any(kind == "own field write", "writes_own_field"), _any((kind == "argument") & (F.col("name") == "this"), "passes_this"))
    tests = methods.groupBy("class").agg(_any(is_test(F.lit(None).cast("string"), F.col("annotations")), "t"))
    sources = classes.join(tests, "class", "left").select(F.col("class").alias("source"), (F.coalesce("t", F.lit(False)) | is_test(F.col("superclass"), F.array().cast("array<string>"))).alias("source_is_test"))
    targets = classes.select(F.col("class").alias("target"), (kind == "interface").alias("target_is_interface"), (kind == "enum").alias("target_is_enum"))
    # Links meet what a method reads before they meet its candidates.
    fields = candidates.select("method", F.col("source").alias("src_class")).distinct().join(body.filter(kind == "field").select("method", F.col("name").alias("dst")).distinct(), "method")
    linked = fields.join(associations.filter("is_container").select(F.col("from_class").alias("src_class"), F.col("to_class").alias("target"), F.col("field").alias("dst")), ["src_class", "dst"]).select("method", F.col("src_class").alias("source"), "target").distinct()
    many = linked.join(candidates.select("method", "source", "target"), ["method", "source", "target"], "left_semi")
    mine = methods.select("method", "name", "return_type", "params", "is_synchronized", "overrides")
    # Signatures meet whole, parameters and all: methods of one name alone would meet in pairs.
    theirs = methods.select(F.col("class").alias("target"), "name", "return_type", F.col("params").alias("other")).distinct()
    either = F.array("params", F.filter("params", lambda p: p != F.col("target")))
    same = candidates.select("method", "target").join(mine, "method").select("method", "target", "name", "return_type", F.explode(F.array_distinct(either)).alias("other"))
    same = same.join(theirs, ["target", "name", "return_type", "other"], "left_semi")
    # What is said of a method and a target is one number for each, so candidates meet it once.
    marks = (
        (body.filter(kind == "parameter write").withColumnRenamed("type", "target"), 1), (body.filter(kind == "null check").withColumnRenamed("type", "target"), 2),
        (many, 4), (reachable, 8), (local_types, 16), (same, 32),
    )
    said = reduce(DataFrame.union, (m.select("method", "target", F.lit(bit).alias("bit")) for m, bit in marks)).groupBy("method", "target").agg(F.bit_or("bit").alias("said"))
    has = lambda bit: (F.coalesce("said", F.lit(0)).bitwiseAND(F.lit(bit)) != 0)
    out = candidates.join(mine.select("method", "is_synchronized", "overrides"), "method", "left").join(own, "method", "left").join(said, ["method", "target"], "left")
    out = out.join(sources, "source", "left").join(targets, "target", "left").withColumns({
        "assigns_target_parameter": has(1), "checks_target_for_null": has(2), "one_to_many": has(4), "no_target_object": ~has(8) | has(16), "signature_in_target": has(32),
    })
    return _decided(out.select("method", "source", "target", *MOVE_METHOD), MOVE_METHOD)


#: What is said of an entity, as bits: it is one of its class, a method, not private, not to be moved, a method that can stay, an
#: instance field, used by another class.
KNOWN, METHOD, VISIBLE, BANNED, STAYS, INSTANCE, OUTSIDE = (1 << k for k in range(7))


def entity_marks() -> Column:
    """The bits of a row of `entities` (see extract_class_rules)."""
    method, known = F.col("kind") == "method", F.coalesce(is_well_known(F.col("name"), F.col("params"), F.col("return_type")), F.lit(False))
    serial = known & F.col("name").isin("readObject", "writeObject")
    flags = (
        (method, METHOD), (F.col("access") != "private", VISIBLE),
        (method & (F.greatest("is_synchronized", "calls_super", "overrides", "is_abstract", "reads_enclosing") | serial), BANNED),
        (method & ~F.greatest("is_static", "is_abstract", "is_accessor", "is_delegate") & ~known, STAYS), (~method & ~F.col("is_static"), INSTANCE),
    )
    return reduce(Column.bitwiseOR, (F.when(flag, bit).otherwise(0) for flag, bit in flags), F.lit(KNOWN))


def extract_class_counts(said: DataFrame) -> DataFrame:
    """candidate, class, size, source_deps, extracted_deps (what its methods use outside and inside of it) with EXTRACT_CLASS and
    `applicable`.

    said: class, entity and, each or null, a candidate of the class that holds it, dst (an entity of the class that it uses), and
    marks (bits of it). Every step groups by the class and more, so rows that are dealt by class are shuffled once.
    """
    kind = said.schema["candidate"].dataType
    none, marks = F.array().cast(ArrayType(kind)), F.coalesce(F.bit_or("marks"), F.lit(0)).alias("marks")
    each = said.filter("class IS NOT NULL AND entity IS NOT NULL").groupBy("class", "entity").agg(marks, F.array_sort(F.collect_set("candidate")).alias("held"), F.collect_set("dst").alias("uses"))
    row = lambda entity, bits, held, used: F.struct(entity.alias("entity"), bits.alias("marks"), held.alias("held"), used.alias("used"))
    # What is used learns which candidates use it.
    used = F.transform(F.filter("uses", lambda _: F.size("held") > 0), lambda x: row(x, F.lit(0), none, F.col("held")))
    met = each.select("class", F.inline(F.concat(F.array(row(F.col("entity"), F.col("marks"), F.col("held"), none)), used)))
    met = met.groupBy("class", "entity").agg(marks, F.max("held").alias("held"), F.flatten(F.collect_set("used")).alias("used"))
    has = lambda bit: F.col("marks").bitwiseAND(F.lit(bit)) != 0
    # A row without a candidate counts for the whole class.
    rows = met.filter(has(KNOWN)).select("class", "marks", "held", "used", F.explode(F.concat(F.array(F.lit(None).cast(kind)), F.array_union("held", "used"))).alias("candidate"))
    rows = rows.select("class", "candidate", "marks", F.col("candidate").isNull().alias("all"), *(F.coalesce(F.array_contains(c, F.col("candidate")), F.lit(False)).alias(c) for c in ("held", "used")))
    held, used, method = F.col("held"), F.col("used"), has(METHOD)
    n = rows.groupBy("class", "candidate").agg(
        _any(held & has(BANNED), "banned_method"), _any(held & ~method & has(VISIBLE) & has(OUTSIDE), "visible_field_used_outside"), _any(held & ~method & ~used, "field_not_accessed"),
        F.count_if(held).alias("size"), F.count_if(held & method).alias("methods"), F.count_if(held & has(STAYS)).alias("stay"), F.count_if(held & has(INSTANCE)).alias("fields"),
        F.count_if(used & ~held).alias("source_deps"), F.count_if(used & held).alias("extracted_deps"),
        F.count_if(F.col("all") & has(STAYS)).alias("all_stay"), F.count_if(F.col("all") & has(INSTANCE)).alias("all_fields"),
    )
    whole = W.partitionBy("class")
    n = n.withColumns({c: F.max(c).over(whole) for c in ("all_stay", "all_fields")}).filter("candidate IS NOT NULL AND size > 0")
    out = n.withColumns({"too_small": F.col("size") <= 2, "no_method": F.col("methods") == 0, "no_method_remains": F.col("all_stay") <= F.col("stay"), "no_field_remains": F.col("all_fields") <= F.col("fields")})
    return _decided(out.select("candidate", "class", *EXTRACT_CLASS, "size", "source_deps", "extracted_deps"), EXTRACT_CLASS)


def extract_class_rules(candidates: DataFrame, entities: DataFrame, accesses: DataFrame) -> DataFrame:
    """candidate, class with EXTRACT_CLASS and `applicable`, of candidates (candidate, class, entity: one row for each entity).

    entities: class, entity, kind (method or field), access, is_static, is_abstract, is_synchronized, overrides, calls_super,
    reads_enclosing, is_accessor, is_delegate, name, params, return_type. accesses: src, dst, src_class.
    """
    homes = entities.select(F.col("entity").alias("dst"), F.col("class"))
    met = accesses.select("src", "dst", "src_class").distinct().join(homes, "dst")
    no = lambda c, df, of: F.lit(None).cast(df.schema[of].dataType).alias(c)
    one = entities.select("class", "entity", no("candidate", candidates, "candidate"), no("dst", entities, "entity"), entity_marks().alias("marks"))
    two = candidates.select("class", "entity", "candidate", no("dst", entities, "entity"), F.lit(0).alias("marks"))
    three = met.select("class", F.col("src").alias("entity"), no("candidate", candidates, "candidate"), "dst", F.lit(0).alias("marks"))
    four = met.filter(F.col("src_class") != F.col("class")).select("class", F.col("dst").alias("entity"), no("candidate", candidates, "candidate"), no("dst", entities, "entity"), F.lit(OUTSIDE).alias("marks"))
    return extract_class_counts(reduce(DataFrame.union, (one, two, three, four))).select("candidate", "class", *EXTRACT_CLASS, "applicable")


def slice_rules(slices: DataFrame, members: DataFrame, nodes: DataFrame, edges: DataFrame, region: DataFrame, returned: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """slices (slice, method, variable, method_size) with SLICE and `applicable`.

    members: slice, node, criterion, removable, indispensable. nodes: method, node, kind (exit, try, break, continue or other),
    loop (a branch's innermost loop), declares, closes (in a finally block), creates, touches (arrays of variables), defines
    (array of name, is_field, composite). edges: method, src, dst, dep, variable. region: slice, node, of the slice's block.
    returned: method, variable.
    """
    head = slices.select("slice", "method", "variable", "method_size")
    x = members.join(head, "slice").join(nodes, ["method", "node"])
    declared = x.select("slice", F.explode("declares").alias("v")).distinct()
    closed = x.filter("kind = 'try'").select("slice", F.explode("closes").alias("v")).distinct()
    closed_here = declared.join(closed, ["slice", "v"], "left_semi")
    state = x.filter("indispensable").select("slice", F.explode("defines").alias("d")).select("slice", F.col("d.name").alias("v"), "d.is_field", "d.composite")
    undeclared = state.join(declared, ["slice", "v"], "left_anti").filter("composite").select("slice")
    changed = undeclared.unionByName(state.filter("NOT composite AND is_field").select("slice")).distinct()
    loops = x.filter("kind IN ('break', 'continue') AND loop IS NOT NULL").select("slice", F.col("loop").alias("node"))
    loose = loops.join(members, ["slice", "node"], "left_anti").select("slice").distinct()
    # Edges of the region, with what the slice does with both ends.
    inside = region.join(head.select("slice", "method"), "slice")
    e = edges.join(inside.withColumnRenamed("node", "src"), ["method", "src"]).join(region.withColumnRenamed("node", "dst"), ["slice", "dst"])
    ends = lambda c, p: members.select("slice", F.col("node").alias(c), F.col("removable").alias(f"{p}_removable"), F.col("indispensable").alias(f"{p}_kept"))
    e = e.join(ends("src", "s"), ["slice", "src"], "left").join(ends("dst", "d"), ["slice", "dst"], "left").fillna(False, ["s_removable", "d_removable"])
    fixed = ~F.col("s_removable") & ~F.col("d_kept")
    fed = e.filter((F.col("dep") == "data") & ~F.col("s_removable")).select("slice", F.col("dst").alias("src"), "variable").distinct()
    anti = e.filter((F.col("dep") == "anti") & fixed).join(fed, ["slice", "src", "variable"], "left_anti").select("slice").distinct()
    output = e.filter((F.col("dep") == "output") & fixed).select("slice").distinct()
    held = nodes.select("method", F.col("node").alias("src"), "creates").filter(F.size("creates") > 0)
    created = e.filter("s_kept AND d_removable").join(held, ["method", "src"]).join(nodes.select("method", F.col("node").alias("dst"), "touches"), ["method", "dst"]).filter(F.arrays_overlap("creates", "touches")).select("slice").distinct()
    # From exits up through control dependences, a level a round, for the exits of these methods alone.
    exits = nodes.filter("kind = 'exit'").join(head.select("method").distinct(), "method", "left_semi").select("method", "node")
    above = control_ancestors(exits, edges)
    depends = above.select("method", F.col("ancestor").alias("node")).distinct().join(head.select("slice", "method"), "method").join(members.select("slice", "node"), ["slice", "node"]).select("slice").distinct()
    has = F.array_contains("declares", F.col("variable"))
    n = x.groupBy("slice").agg(
        F.count(F.lit(1)).alias("size"), F.count_if("criterion").alias("criteria"), F.count_if("removable").alias("removed"), F.count_if(F.col("criterion") & ~F.col("indispensable")).alias("free_criteria"),
        _any(has, "declares_variable"), _any(has & F.col("indispensable") & (F.col("kind") != "try"), "declaration_duplicated"), _any(F.col("kind") == "exit", "holds_exit"),
        _any((F.col("kind") == "try") & F.array_contains("closes", F.col("variable")), "closes_variable"),
    )
    out = head.join(n, "slice").join(returned.select("method", "variable").distinct().withColumn("variable_returned", F.lit(True)), ["method", "variable"], "left")
    for name, broken in {"duplicated_state_change": changed, "anti_dependence": anti, "output_dependence": output, "duplicated_creation": created, "branch_without_loop": loose, "declaration_closed": closed_here.select("slice").distinct(), "depends": depends}.items():
        out = out.join(broken.withColumn(name, F.lit(True)), "slice", "left")
    size, duplicated = F.col("size"), F.col("size") - F.col("removed")
    out = out.select(
        "slice", "method", "variable", (size == F.col("method_size")).alias("whole_body"), ((size == 2) & F.col("declares_variable")).alias("lone_criterion"), "declaration_duplicated", "variable_returned",
        (size <= F.col("criteria")).alias("criteria_alone"), (F.col("free_criteria") == 0).alias("criteria_duplicated"), (F.coalesce("depends", F.lit(False)) | F.col("holds_exit")).alias("exit_depends"), "holds_exit",
        "duplicated_state_change", "anti_dependence", "output_dependence", "duplicated_creation",
        ((size < t.min_slice) | (size > F.col("method_size") - t.max_slice_slack) | (duplicated > t.max_duplication) | (duplicated / size > t.max_duplication_ratio)).alias("over_thresholds"),
        "branch_without_loop", (F.col("declares_variable") & F.col("closes_variable")).alias("criterion_closed"), "declaration_closed",
    )
    return _decided(out, SLICE)


def control_ancestors(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """method, node, ancestor: nodes that a node (method, node) is control dependent on, directly or through others."""
    up = edges.filter("dep = 'control'").select("method", F.col("dst").alias("at"), F.col("src").alias("ancestor")).distinct()
    found = Rounds(starts.join(up.withColumnRenamed("at", "node"), ["method", "node"]).select("method", "node", "ancestor"))
    while not found.new.isEmpty():
        step = found.new.select("method", "node", F.col("ancestor").alias("at")).join(up, ["method", "at"]).select("method", "node", "ancestor").distinct()
        found.add(step.join(found.known, ["method", "node", "ancestor"], "left_anti"))
    return found.known


def envied_elements(sets: DataFrame) -> DataFrame:
    """entity, target, n: distinct elements of an entity's set (entity, target, owner, member) that the target owns."""
    mine = F.when(F.col("owner") == F.col("target"), F.col("member"))
    return sets.groupBy("entity", "target").agg(F.count_distinct(mine).alias("n"))


def accessible_members(members: DataFrame) -> DataFrame:
    """class, n: members (class, kind, name, access, is_static) neither private nor static, without constructors and main methods."""
    open_ = (F.col("access") != "private") & ~F.col("is_static") & ~((F.col("kind") == "method") & (F.col("name") == "main")) & (F.col("kind") != "constructor")
    return members.groupBy("class").agg(F.count_if(open_).alias("n"))


def id_shift(mappings: DataFrame, by: list[str]) -> DataFrame:
    """by, id_shift: how far the ids of mapped nodes (a, b) are apart, each counted from its least mapped id."""
    least = mappings.groupBy(*by).agg(F.min("a").alias("a0"), F.min("b").alias("b0"))
    return mappings.join(least, by).groupBy(*by).agg(F.sum(F.abs((F.col("a") - F.col("a0")) - (F.col("b") - F.col("b0")))).alias("id_shift"))


def statements_per_case(cases: DataFrame) -> DataFrame:
    """candidate, avg_statements, all_empty of cases (candidate, is_default, statements); an empty default isn't a case."""
    counted = cases.filter(~F.col("is_default") | (F.col("statements") > 0))
    return counted.groupBy("candidate").agg(F.avg("statements").alias("avg_statements"), F.bool_and(F.col("is_default") | (F.col("statements") == 0)).alias("all_empty"))


def linked_blocks(blocks: DataFrame, graph: str, order: str, block: str) -> DataFrame:
    """With the block before and the block after in the same flow graph."""
    from pyspark.sql import Window as W

    w = W.partitionBy(graph).orderBy(order)
    return blocks.withColumn("before", F.lag(block).over(w)).withColumn("after", F.lead(block).over(w))


def first_and_last(touches: DataFrame, by: list[str]) -> DataFrame:
    """by, first_definition, last_use of a variable's nodes (node, mode: def or use)."""
    at = lambda m: F.when(F.col("mode") == m, F.col("node"))
    return touches.groupBy(*by).agg(F.min(at("def")).alias("first_definition"), F.max(at("use")).alias("last_use"))


def best_of_groups(candidates: DataFrame, group: str, target: str = "extracted_deps") -> DataFrame:
    """group, source_deps, target of each group's best candidate: fewest source dependencies, most target ones.

    Groups are ordered by that and then by name, as their candidates are, so one aggregate with map-side combine is enough.
    """
    best = F.min(F.struct(F.col("source_deps"), (-F.col(target)).alias("t"))).alias("b")
    return candidates.groupBy(group).agg(best).select(group, F.col("b.source_deps").alias("source_deps"), (-F.col("b.t")).alias(target))


def unified_text(tokens: DataFrame, by: list[str]) -> DataFrame:
    """by, text: the tokens (position, token) of a statement in order, joined by blanks."""
    rows = F.array_sort(F.collect_list(F.struct("position", "token")))
    return tokens.groupBy(*by).agg(F.array_join(F.transform(rows, lambda r: r["token"]), " ").alias("text"))


def of_kind(rows: DataFrame, *kinds: str, column: str = "kind") -> DataFrame:
    """Statements or expressions of these kinds: an equality that the scan takes over."""
    return rows.filter(F.col(column).isin(*kinds))


def statement_counts(statements: DataFrame, by: list[str]) -> DataFrame:
    """by, kind, n, total: statements of each kind, and of all kinds."""
    n = statements.groupBy(*by, "kind").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(*by).agg(F.sum("n").alias("total"))
    return n.join(total, by)
