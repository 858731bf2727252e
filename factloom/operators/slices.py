"""Object-state slices: the statements that change the state of one object, with all they need, as a method of their own.

Every set is a table of (slice, node); what a set depends on is walked for each slice over its own dependences, a row of a
kernel. A slice reaches only within its block's region, so its cost is that of these dependences, and no pair of nodes is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from . import rules
from .facts import Thresholds
from .flow import common_boundaries
from .graph import reached, settled, steps_by

#: What stands against extracting an object-state slice.
OBJECT_SLICE = ("whole_body", "minimum_size", *(r for r in rules.SLICE if r not in ("whole_body", "lone_criterion", "criteria_alone")))


def object_heads(state: DataFrame, boundaries: DataFrame) -> DataFrame:
    """slice, method, object, block: a slice for each block that is a boundary of every node that changes an object.

    state: method, node, object, a row for each node that defines an attribute of the object (repeated rows count once).
    boundaries: method, node, block. An object without a common block has no slice.
    """
    met = state.select("method", "node", "object").distinct().join(boundaries, ["method", "node"], "left")
    common = common_boundaries(met.select(F.col("method").alias("g"), F.col("object").alias("var"), "node", "block")).filter("block IS NOT NULL")
    key = F.struct(F.col("g").alias("method"), F.col("var").alias("object"), "block")
    return common.select(key.alias("slice"), F.col("g").alias("method"), F.col("var").alias("object"), "block")


def object_slices(heads: DataFrame, state: DataFrame, nodes: DataFrame, variables: DataFrame, edges: DataFrame, region: DataFrame) -> DataFrame:
    """slice, node, criterion, removable, indispensable: the nodes of each slice of heads (slice, method, object, block).

    state: as in object_heads. nodes: method, node, kind (throw, try, ...), uses, declares, renews (arrays of names; renews are
    those that the node gives a new object). variables: method, variable, is_field, is_parameter (a missing one is local).
    edges: method, src, dst, dep, variable; src 0 is the entry. region: method, block, node.

    A slice holds what its criteria depend on by control or data within the region; all that changes other objects it uses, with
    what that needs; and throws nested in it. Indispensable is what remaining nodes need, and throws nested in those or in what is
    indispensable; the first declaration of the object is removable at any rate.
    """
    inside = settled(heads.join(region, ["method", "block"]).select("slice", "method", "object", "node"))
    feeds = edges.filter("dep IN ('control', 'data')").select("method", F.col("dst").alias("node"), F.col("src").alias("next")).distinct()
    needs = inside.join(feeds, ["method", "node"]).select("slice", "node", "next")
    needs = steps_by(needs.join(inside.select("slice", F.col("node").alias("next")), ["slice", "next"], "left_semi"), "slice")
    changes = state.select("method", "node", "object").distinct()
    criteria = heads.join(changes, ["method", "object"]).select("slice", "node")
    depended_on = lambda starts: reached(starts, needs, "slice")
    own = settled(depended_on(criteria))

    # Other objects that the slice uses bring in all that changes them in the region.
    used = own.join(heads, "slice").join(nodes.select("method", "node", F.explode("uses").alias("other")), ["method", "node"]).filter("other <> object").select("slice", "method", "other").distinct()
    others = used.join(changes.withColumnRenamed("object", "other"), ["method", "other"]).select("slice", "node").join(inside.select("slice", "node"), ["slice", "node"], "left_semi")
    body = settled(own.union(depended_on(others)).distinct())

    # Throws of the region, with all they are nested in.
    throws = nodes.filter("kind = 'throw'").select("method", "node").join(heads.select("method").distinct(), "method", "left_semi")
    above = rules.control_ancestors(throws, edges)
    nested = settled(inside.join(above, ["method", "node"]).select("slice", "node", "ancestor"))
    thrown = lambda of: nested.join(of.withColumnRenamed("node", "ancestor"), ["slice", "ancestor"], "left_semi").select("slice", "node").distinct()
    body = settled(body.union(depended_on(thrown(body))).distinct())
    held = body.withColumn("held", F.lit(True))

    # What remaining nodes need: sources in the slice of edges that leave it. The entry always remains.
    out = heads.join(edges.filter("dep IN ('control', 'data') AND dst <> 0"), "method").join(body.withColumnRenamed("node", "src"), ["slice", "src"], "left_semi")
    out = out.join(body.withColumnRenamed("node", "dst"), ["slice", "dst"], "left_anti").join(variables.select("method", "variable", "is_field"), ["method", "variable"], "left")
    local = (F.col("dep") == "data") & (F.col("variable") != F.col("object")) & ~F.coalesce("is_field", F.lit(False))
    kept = settled(depended_on(out.filter((F.col("dep") == "control") | local).select("slice", F.col("src").alias("node"))))
    # A throw also stays for a node outside the slice that it is nested in; such ancestors may lie outside the region.
    outside = nested.filter("ancestor <> 0").join(held.withColumnRenamed("node", "ancestor"), ["slice", "ancestor"], "left").filter("held IS NULL").select("slice", "node")
    more = depended_on(outside.union(thrown(kept)))
    kept = kept.union(more).distinct().withColumn("indispensable", F.lit(True))

    rows = body.join(heads, "slice").join(nodes.select("method", "node", "kind", "declares", "renews"), ["method", "node"], "left")
    rows = rows.join(variables.withColumnRenamed("variable", "object"), ["method", "object"], "left")
    declares = F.coalesce(F.array_contains("declares", F.col("object")), F.lit(False))
    renews = F.coalesce((F.col("is_field") | F.col("is_parameter")) & F.array_contains("renews", F.col("object")), F.lit(False))
    born = rows.filter((declares | renews) & (F.col("kind") != "try")).groupBy("slice").agg(F.min("node").alias("born"))
    marked = body.join(kept, ["slice", "node"], "left").join(criteria.distinct().withColumn("criterion", F.lit(True)), ["slice", "node"], "left").join(born, "slice", "left")
    stays = F.coalesce("indispensable", F.lit(False)) & ~F.coalesce(F.col("born") == F.col("node"), F.lit(False))
    return settled(marked.select("slice", "node", F.coalesce("criterion", F.lit(False)).alias("criterion"), (~stays).alias("removable"), stays.alias("indispensable")))


def passed_parameters(heads: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """slice, variable: what nodes outside a slice define and nodes of it use."""
    e = heads.select("slice", "method").join(edges.filter("dep = 'data'"), "method").join(members.select("slice", F.col("node").alias("dst")), ["slice", "dst"], "left_semi")
    return e.join(members.select("slice", F.col("node").alias("src")), ["slice", "src"], "left_anti").select("slice", "variable").distinct()


def object_slice_rules(heads: DataFrame, members: DataFrame, sizes: DataFrame, nodes: DataFrame, edges: DataFrame, region: DataFrame, returned: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """slice, method, variable (the object) with OBJECT_SLICE and `applicable`.

    heads and region: as in object_slices; members: its result; sizes: method, method_size; nodes, edges, returned: as in
    rules.slice_rules. A slice is the whole body also where it lacks one return alone, and has minimum size where it is one
    node, or two that declare the object.
    """
    x = heads.join(sizes, "method").select("slice", "method", F.col("object").alias("variable"), "method_size")
    inside = heads.join(region, ["method", "block"]).select("slice", "node")
    out = settled(rules.slice_rules(x, members, nodes, edges, inside, returned, t).drop("lone_criterion", "criteria_alone", "applicable", "whole_body"))
    of = members.join(x, "slice").join(nodes.select("method", "node", "kind", "declares"), ["method", "node"])
    n = of.groupBy("slice").agg(
        F.count(F.lit(1)).alias("size"), F.count_if(F.col("kind") == "exit").alias("exits"), F.first("method_size").alias("method_size"),
        F.bool_or(F.array_contains("declares", F.col("variable"))).alias("declared"),
    )
    exits = nodes.filter("kind = 'exit'").groupBy("method").agg(F.count(F.lit(1)).alias("all_exits"))
    out = out.join(n, "slice").join(exits, "method", "left").withColumns({
        "whole_body": (F.col("size") == F.col("method_size")) | ((F.col("size") == F.col("method_size") - 1) & (F.col("all_exits") > F.col("exits"))),
        "minimum_size": (F.col("size") == 1) | ((F.col("size") == 2) & F.col("declared")),
    })
    return rules._decided(out.select("slice", "method", "variable", *OBJECT_SLICE), OBJECT_SLICE)


def whole_method_rules(methods: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """method, variable, block with OBJECT_SLICE and `applicable`: object_heads, object_slices and object_slice_rules at once, for
    methods that are a row each, so that no set of a slice's nodes is ever shuffled.

    methods: method; nodes: an array of node, kind, loop, blocks (in whose region it is), changes (objects whose state it changes),
    and uses, declares, renews, closes, creates, touches, defines as above; edges: an array of src, dst, dep, variable; fields,
    parameters, returned: arrays of variables. A slice begins at each block whose region has all changes of its object.
    """
    nodes = methods.schema["nodes"].dataType.elementType
    kinds = [nodes["changes"].dataType.elementType, nodes["blocks"].dataType.elementType]
    out = StructType([methods.schema["method"], StructField("variable", kinds[0]), StructField("block", kinds[1]), *(StructField(r, BooleanType()) for r in OBJECT_SLICE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                at, rows = [], []
                for i, m in enumerate(zip(*(b.column(c).to_pylist() for c in ("nodes", "edges", "fields", "parameters", "returned")), strict=True)):
                    got = _method_rules(*m, t)
                    at += [i] * len(got)
                    rows += got
                cols = list(zip(*rows, strict=True)) or [()] * (2 + len(OBJECT_SLICE))
                arrays = [pa.array(c, pa.int64() if f.dataType.typeName() == "long" else pa.string() if f.dataType.typeName() == "string" else pa.bool_()) for c, f in zip(cols, out.fields[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("method").take(pa.array(at, pa.int64())), *arrays], names=out.names)

    return rules._decided(methods.mapInArrow(run, out), OBJECT_SLICE)


def _places(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def _method_rules(nodes: list[dict], edges: list[dict], fields: list[str], parameters: list[str], returned: list[str], t: Thresholds) -> list[tuple]:
    """The rows of one method. Sets of nodes are bits of a number; the entry and what else isn't a node has no bit."""
    nodes = sorted(nodes, key=lambda x: x["node"])
    bit = {x["node"]: 1 << i for i, x in enumerate(nodes)}
    names = lambda c: [frozenset(v for v in x[c] or () if v is not None) for x in nodes]
    uses, declares, renews, closes, creates, touches = map(names, ("uses", "declares", "renews", "closes", "creates", "touches"))
    of_kind = lambda *k: sum(1 << i for i, x in enumerate(nodes) if x["kind"] in k)
    throws, exits, tries, branches = of_kind("throw"), of_kind("exit"), of_kind("try"), of_kind("break", "continue")
    changed: dict[str, int] = {}
    region: dict[int, int] = {}
    declaring: dict[str, int] = {}
    renewing: dict[str, int] = {}
    for i, x in enumerate(nodes):
        for groups, keys in ((changed, x["changes"]), (region, x["blocks"]), (declaring, declares[i]), (renewing, renews[i])):
            for key in keys or ():
                if key is not None:
                    groups[key] = groups.get(key, 0) | 1 << i
    feeds, over = [0] * len(nodes), [0] * len(nodes)
    for e in edges:
        if e["dst"] in bit and e["dep"] in ("control", "data"):
            i, src = bit[e["dst"]].bit_length() - 1, bit.get(e["src"], 0)
            feeds[i] |= src
            if e["dep"] == "control":
                over[i] |= src
    above: dict[int, int] = {}
    for i in _places(throws | exits):
        seen, todo = 0, over[i]
        while todo:
            seen |= todo
            step = 0
            for j in _places(todo):
                step |= over[j]
            todo = step & ~seen
        above[i] = seen
    over_exits = 0
    for i in _places(exits):
        over_exits |= above[i]
    fields_, givens = set(fields or ()), set(fields or ()) | set(parameters or ())

    rows = []
    for name, criteria in sorted(changed.items()):
        for block, inside in sorted(region.items()):
            if criteria & ~inside:
                continue

            def reach(start: int, inside: int = inside) -> int:
                seen, todo = start, start & inside
                while todo:
                    step = 0
                    for i in _places(todo):
                        step |= feeds[i]
                    todo = step & inside & ~seen
                    seen |= todo
                return seen

            def thrown(of: int, inside: int = inside) -> int:
                return sum(1 << i for i in _places(throws & inside) if above[i] & of)

            own = reach(criteria)
            others = 0
            for other in set().union(*(uses[i] for i in _places(own))) - {name}:
                others |= changed.get(other, 0)
            body = own | reach(others & inside)
            body |= reach(thrown(body))
            leaves = 0
            for e in edges:
                src = bit.get(e["src"], 0)
                if src & body and e["dst"] != 0 and not bit.get(e["dst"], 0) & body and e["dep"] in ("control", "data"):
                    v = e["variable"]
                    if e["dep"] == "control" or (v is not None and v != name and v not in fields_):
                        leaves |= src
            kept = reach(leaves)
            kept |= reach(thrown(kept) | sum(1 << i for i in _places(throws & inside) if above[i] & ~body))
            born = body & ~tries & (declaring.get(name, 0) | (renewing.get(name, 0) if name in givens else 0))
            stays = kept & body & ~(born & -born)
            free = body & ~stays

            size = body.bit_count()
            declared = set().union(*(declares[i] for i in _places(body)))
            state = [d for i in _places(stays) for d in nodes[i]["defines"] or ()]
            fed, anti, output, created = set(), [], False, False
            for e in edges:
                src, dst = bit.get(e["src"], 0), bit.get(e["dst"], 0)
                if not (src & inside and dst & inside):
                    continue
                if e["dep"] == "data" and not src & free:
                    fed.add((e["dst"], e["variable"]))
                if not src & free and dst & free:
                    anti += [(e["src"], e["variable"])] if e["dep"] == "anti" else []
                    output |= e["dep"] == "output"
                if src & stays and dst & free and not created:
                    created = bool(creates[src.bit_length() - 1] & touches[dst.bit_length() - 1])
            holder = body & declaring.get(name, 0)
            duplicated = stays.bit_count()
            said = {
                "whole_body": size == len(nodes) or (size == len(nodes) - 1 and exits.bit_count() > (exits & body).bit_count()),
                "minimum_size": size == 1 or (size == 2 and bool(holder)),
                "declaration_duplicated": bool(holder & stays & ~tries), "variable_returned": name in (returned or ()), "criteria_duplicated": not criteria & free,
                "exit_depends": bool((over_exits | exits) & body), "holds_exit": bool(exits & body),
                "duplicated_state_change": any((d["composite"] and d["name"] not in declared) or (d["composite"] is False and d["is_field"]) for d in state),
                "anti_dependence": any(a[1] is None or a not in fed for a in anti), "output_dependence": output, "duplicated_creation": created,
                "over_thresholds": size < t.min_slice or size > len(nodes) - t.max_slice_slack or duplicated > t.max_duplication or duplicated / size > t.max_duplication_ratio,
                "branch_without_loop": any(nodes[i]["loop"] is not None and not bit.get(nodes[i]["loop"], 0) & body for i in _places(branches & body)),
                "criterion_closed": bool(holder) and any(name in closes[i] for i in _places(tries & body)),
                "declaration_closed": any(closes[i] & declared for i in _places(tries & body)),
            }
            rows.append((name, block, *(bool(said[r]) for r in OBJECT_SLICE)))
    return rows
