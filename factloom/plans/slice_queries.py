"""Registered queries of object-state slices, with their SQL.

Roles: a user is a method and the user's events, in order of time, are its nodes; each handles one of six objects. Clicks change
the object's state, sign-ups give it a new object (and declare it, but for o0, a field, and o1, a parameter), views are
predicates, purchases use it and some break a loop; errors throw, return, use it, or close it in a finally block. Event k depends by
control on event k/2 if that is a view. A block begins at every eighth event, and its region is all from there on.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import slices
from ..operators.facts import Thresholds
from ..operators.flow import straight_dependences
from ..operators.graph import settled
from ..sources.tables import partitions_for, table
from .catalogue import query

T = Thresholds(min_slice=2, max_slice_slack=2, max_duplication=4, max_duplication_ratio=0.5)
BLOCK = 8
KIND = "CASE WHEN event_type = 'view' THEN 'predicate' WHEN event_type = 'purchase' AND v % 9 = 0 THEN 'break' WHEN event_type <> 'error' THEN 'other' WHEN v % 4 = 0 THEN 'throw' WHEN v % 4 = 1 THEN 'exit' WHEN v % 4 = 2 THEN 'other' ELSE 'try' END"
USES = "event_type IN ('click', 'purchase', 'view') OR (event_type = 'error' AND v % 4 = 2)"


def _events(spark, d, tasks=None):
    """method, node, event_type, v, o, kind, use, new, change of all events, dealt by method to so many tasks."""
    k = F.row_number().over(W.partitionBy("method").orderBy("ts", "event_id")).cast("long")
    e = table(spark, d, "events").select(F.col("user_id").alias("method"), "ts", "event_id", "event_type", F.floor("value").cast("long").alias("v"))
    if tasks:
        e = e.repartition(tasks, "method")
    e = e.select("method", k.alias("node"), "event_type", "v")
    e = e.withColumn("o", F.concat(F.lit("o"), (F.col("v") % 6).cast("string"))).withColumn("kind", F.expr(KIND)).withColumn("use", F.expr(USES))
    return e.withColumns({"new": F.col("event_type") == "signup", "change": F.col("event_type") == "click"})


def _methods(spark, d):
    """The same facts as a row for each user (see slices.whole_method_rules). Events are dealt by user once."""
    names = lambda c: F.when(c, F.array("o")).otherwise(F.array().cast("array<string>"))
    local, defines = ~F.col("o").isin("o0", "o1"), F.col("new") | F.col("change")
    w = W.partitionBy("method", "o").orderBy("node")
    definition = F.when(defines & F.col("o").isNotNull(), F.col("node"))
    tasks = partitions_for(table(spark, d, "events"), 50_000)  # rows are few beside the work on them
    e = _events(spark, d, tasks).filter("method IS NOT NULL").withColumns({
        "before": F.last(definition, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)), "after": F.first(definition, ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing)),
    })
    one = F.struct(
        "node", "kind", F.expr(f"sequence(0L, (node - 1) div {BLOCK})").alias("blocks"), names(F.col("change")).alias("changes"), names(F.col("use")).alias("uses"), names(F.col("new") & local).alias("declares"),
        names(F.col("new") & ~local).alias("renews"), names(F.col("kind") == "try").alias("closes"), names(F.col("new")).alias("creates"), names(F.col("event_type").isin("click", "purchase")).alias("touches"),
        F.when(defines, F.array(F.struct(F.col("o").alias("name"), (F.col("o") == "o0").alias("is_field"), F.col("change").alias("composite")))).alias("defines"),
        F.col("o").alias("owner"), F.when(F.col("use"), F.col("before")).alias("before"), F.col("after"), F.col("use"), defines.alias("def"),
    )
    m = e.groupBy("method").agg(F.sort_array(F.collect_list(one)).alias("e"))
    up = lambda x: F.when(x["node"] > 1, F.get(F.col("e"), F.shiftright(x["node"], 1).cast("int") - 1))
    loop = lambda x: F.when(up(x)["kind"] == "predicate", up(x)["node"])
    m = m.withColumn("e", F.transform("e", lambda x: x.withField("loop", loop(x))))
    edge = lambda src, dst, dep, variable: F.struct(src.alias("src"), dst.alias("dst"), F.lit(dep).alias("dep"), variable.alias("variable"))
    edges = F.transform("e", lambda x: F.array(
        edge(F.coalesce(x["loop"], F.lit(0).cast("long")), x["node"], "control", F.lit(None).cast("string")), edge(x["before"], x["node"], "data", x["owner"]),
        F.when(x["use"], edge(x["node"], x["after"], "anti", x["owner"])), F.when(x["def"], edge(x["node"], x["after"], "output", x["owner"])),
    ))
    whole = F.filter(F.flatten(edges), lambda x: x["src"].isNotNull() & x["dst"].isNotNull())
    fields = ["node", "kind", "loop", "blocks", "changes", "uses", "declares", "renews", "closes", "creates", "touches", "defines"]
    nodes = F.transform("e", lambda x: F.struct(*(x[c].alias(c) for c in fields)))
    returned = F.array_distinct(F.transform(F.filter("e", lambda x: x["kind"] == "exit"), lambda x: x["owner"]))
    return m.select("method", nodes.alias("nodes"), whole.alias("edges"), F.array(F.lit("o0")).alias("fields"), F.array(F.lit("o1")).alias("parameters"), returned.alias("returned"))


def _facts(spark, d):
    """heads, state, nodes, variables, edges and region of all users."""
    e = settled(_events(spark, d).withColumn("up", F.expr("shiftright(node, 1)")))
    views = e.filter("kind = 'predicate'").select("method", F.col("node").alias("up"), F.col("node").alias("loop"))
    e = settled(e.join(views, ["method", "up"], "left"))
    local = ~F.col("o").isin("o0", "o1")
    names = lambda c: F.when(c, F.array("o")).otherwise(F.array().cast("array<string>"))
    defines = F.when(F.col("new") | F.col("change"), F.array(F.struct(F.col("o").alias("name"), (F.col("o") == "o0").alias("is_field"), F.col("change").alias("composite"))))
    nodes = e.select(
        "method", "node", "kind", F.when(F.col("kind") == "break", F.col("loop")).alias("loop"), names(F.col("use")).alias("uses"), F.array("o").alias("owner"), names(F.col("new") & local).alias("declares"), names(F.col("new") & ~local).alias("renews"),
        names(F.col("kind") == "try").alias("closes"), names(F.col("new")).alias("creates"), names(F.col("event_type").isin("click", "purchase")).alias("touches"), defines.alias("defines"),
    )
    straight = straight_dependences(e.withColumn("line", F.struct("method", "o")), "line", "node", "node", F.col("new") | F.col("change"), F.col("use"))
    edges = e.select("method", F.coalesce("loop", F.lit(0)).alias("src"), F.col("node").alias("dst"), F.lit("control").alias("dep"), F.lit(None).cast("string").alias("variable"))
    for dep, x in straight.items():
        edges = edges.unionByName(x.select(F.col("g.method").alias("method"), "src", "dst", F.lit(dep).alias("dep"), F.col("g.o").alias("variable")))
    state = e.filter("change").select("method", "node", F.col("o").alias("object"))
    block = F.explode(F.sequence(F.lit(0), F.expr(f"(node - 1) div {BLOCK}"))).alias("block")
    region = e.select("method", "node", block)
    variables = e.select("method", F.col("o").alias("variable"), (F.col("o") == "o0").alias("is_field"), (F.col("o") == "o1").alias("is_parameter")).distinct()
    heads = slices.object_heads(state, state.select("method", "node", block))
    return settled(heads), state, nodes, variables, settled(edges), region.hint("merge")


_FACTS = f"""
e AS (SELECT *, {KIND} AS kind, {USES} AS use, event_type = 'signup' AS new, event_type = 'click' AS change, 'o' || v % 6 AS o FROM (SELECT user_id AS m, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, event_type, CAST(floor(value) AS BIGINT) AS v FROM events)),
df AS (SELECT m, k, o FROM e WHERE new OR change),
ed AS (SELECT e.m, coalesce(p.k, 0) AS src, e.k AS dst, 'control' AS dep, NULL::VARCHAR AS var FROM e LEFT JOIN e p ON p.m = e.m AND p.k = e.k >> 1 AND p.kind = 'predicate'
  UNION ALL SELECT u.m, max(f.k), u.k, 'data', u.o FROM e u JOIN df f ON f.m = u.m AND f.o = u.o AND f.k < u.k WHERE u.use GROUP BY u.m, u.k, u.o
  UNION ALL SELECT u.m, u.k, min(f.k), 'anti', u.o FROM e u JOIN df f ON f.m = u.m AND f.o = u.o AND f.k > u.k WHERE u.use GROUP BY u.m, u.k, u.o
  UNION ALL SELECT u.m, u.k, min(f.k), 'output', u.o FROM df u JOIN df f ON f.m = u.m AND f.o = u.o AND f.k > u.k GROUP BY u.m, u.k, u.o),
h AS (SELECT m, o, unnest(range(0, (min(k) - 1) // {BLOCK} + 1)) AS b FROM e WHERE change GROUP BY 1, 2),
nd AS (SELECT DISTINCT m, dst AS k, src AS nx FROM ed WHERE dep IN ('control', 'data') AND src > 0),
own AS (SELECT h.m, h.o, b, k FROM h JOIN e ON e.m = h.m AND e.o = h.o AND e.change UNION SELECT r.m, r.o, b, nx FROM own r JOIN nd ON nd.m = r.m AND nd.k = r.k AND nx > {BLOCK} * b),
others AS (SELECT r.m, r.o, b, c.k FROM own r JOIN e u ON u.m = r.m AND u.k = r.k AND u.use AND u.o <> r.o JOIN e c ON c.m = u.m AND c.o = u.o AND c.change AND c.k > {BLOCK} * b
  UNION SELECT r.m, r.o, b, nx FROM others r JOIN nd ON nd.m = r.m AND nd.k = r.k AND nx > {BLOCK} * b),
body1 AS (SELECT * FROM own UNION SELECT * FROM others),
anc AS (SELECT e.m, e.k, e.k AS at, ed.src AS a FROM e JOIN ed ON ed.m = e.m AND ed.dst = e.k AND dep = 'control' WHERE e.kind IN ('throw', 'exit')
  UNION SELECT anc.m, anc.k, ed.dst, ed.src FROM anc JOIN ed ON ed.m = anc.m AND ed.dst = anc.a AND dep = 'control'),
nested AS (SELECT h.m, h.o, b, anc.k, a FROM h JOIN anc ON anc.m = h.m AND anc.k > {BLOCK} * b JOIN e ON e.m = anc.m AND e.k = anc.k AND e.kind = 'throw'),
th AS (SELECT n.m, n.o, n.b, n.k FROM nested n JOIN body1 r ON r.m = n.m AND r.o = n.o AND r.b = n.b AND r.k = n.a UNION SELECT r.m, r.o, b, nx FROM th r JOIN nd ON nd.m = r.m AND nd.k = r.k AND nx > {BLOCK} * b),
body AS (SELECT * FROM body1 UNION SELECT * FROM th),
kept AS (SELECT r.m, r.o, r.b, r.k FROM body r JOIN ed ON ed.m = r.m AND ed.src = r.k AND (dep = 'control' OR (dep = 'data' AND var <> r.o AND var <> 'o0')) LEFT JOIN body x ON x.m = r.m AND x.o = r.o AND x.b = r.b AND x.k = ed.dst WHERE x.k IS NULL
  UNION SELECT r.m, r.o, b, nx FROM kept r JOIN nd ON nd.m = r.m AND nd.k = r.k AND nx > {BLOCK} * b),
more AS (SELECT n.m, n.o, n.b, n.k FROM nested n LEFT JOIN body r ON r.m = n.m AND r.o = n.o AND r.b = n.b AND r.k = n.a LEFT JOIN kept x ON x.m = n.m AND x.o = n.o AND x.b = n.b AND x.k = n.a WHERE (n.a <> 0 AND r.k IS NULL) OR x.k IS NOT NULL
  UNION SELECT r.m, r.o, b, nx FROM more r JOIN nd ON nd.m = r.m AND nd.k = r.k AND nx > {BLOCK} * b),
stay AS (SELECT * FROM kept UNION SELECT * FROM more),
born AS (SELECT r.m, r.o, r.b, min(r.k) AS born FROM body r JOIN e ON e.m = r.m AND e.k = r.k AND e.new AND e.o = r.o GROUP BY ALL),
mb AS (SELECT r.m, r.o, r.b, r.k, e.o = r.o AND e.change AS criterion, s.k IS NOT NULL AND born.born IS DISTINCT FROM r.k AS kept, e.kind, e.o AS eo, e.new, e.change, e.new AND e.o NOT IN ('o0', 'o1') AS declared
  FROM body r JOIN e ON e.m = r.m AND e.k = r.k LEFT JOIN stay s ON s.m = r.m AND s.o = r.o AND s.b = r.b AND s.k = r.k LEFT JOIN born ON born.m = r.m AND born.o = r.o AND born.b = r.b)"""


@query(f"WITH RECURSIVE {_FACTS} SELECT m AS method, o AS object, b AS block, k AS node, criterion, NOT kept AS removable, kept AS indispensable FROM mb")
def object_slices(spark, d):
    """The nodes of every object's slice from every common block on."""
    got = slices.object_slices(*_facts(spark, d))
    return got.select("slice.*", "node", "criterion", "removable", "indispensable")


@query(f"""WITH RECURSIVE {_FACTS} SELECT m AS method, o AS object, b AS block, var AS variable FROM (SELECT DISTINCT r.m, r.o, r.b, var FROM body r JOIN ed ON ed.m = r.m AND ed.dst = r.k AND dep = 'data' LEFT JOIN body x ON x.m = r.m AND x.o = r.o AND x.b = r.b AND x.k = ed.src WHERE x.k IS NULL)""")
def passed_parameters(spark, d):
    """The variables that each slice takes from the rest of its method."""
    heads, state, nodes, variables, edges, region = _facts(spark, d)
    return slices.passed_parameters(heads, slices.object_slices(heads, state, nodes, variables, edges, region), edges).select("slice.*", "variable")


@query(f"""WITH RECURSIVE {_FACTS},
size AS (SELECT m, count(*) AS ms, count_if(kind = 'exit') AS all_exits FROM e GROUP BY 1),
dec AS (SELECT DISTINCT m, o, b, eo FROM mb WHERE declared),
cl AS (SELECT DISTINCT mb.m, mb.o, mb.b FROM mb JOIN dec ON dec.m = mb.m AND dec.o = mb.o AND dec.b = mb.b AND dec.eo = mb.eo WHERE kind = 'try'),
ch AS (SELECT DISTINCT mb.m, mb.o, mb.b FROM mb LEFT JOIN dec ON dec.m = mb.m AND dec.o = mb.o AND dec.b = mb.b AND dec.eo = mb.eo WHERE kept AND ((change AND dec.m IS NULL) OR (new AND mb.eo = 'o0'))),
re AS (SELECT h.m, h.o, h.b, src, dst, dep, var, s.k IS NOT NULL AND NOT s.kept AS s_free, coalesce(s.kept, false) AS s_kept, d.k IS NOT NULL AND NOT d.kept AS d_free FROM h JOIN ed ON ed.m = h.m AND src > {BLOCK} * h.b AND dst > {BLOCK} * h.b LEFT JOIN mb s ON s.m = h.m AND s.o = h.o AND s.b = h.b AND s.k = src LEFT JOIN mb d ON d.m = h.m AND d.o = h.o AND d.b = h.b AND d.k = dst),
fed AS (SELECT DISTINCT m, o, b, dst, var FROM re WHERE dep = 'data' AND NOT s_free),
an AS (SELECT DISTINCT re.m, re.o, re.b FROM re LEFT JOIN fed ON fed.m = re.m AND fed.o = re.o AND fed.b = re.b AND fed.dst = re.src AND fed.var = re.var WHERE dep = 'anti' AND NOT s_free AND d_free AND fed.m IS NULL),
ou AS (SELECT DISTINCT m, o, b FROM re WHERE dep = 'output' AND NOT s_free AND d_free),
cr AS (SELECT DISTINCT re.m, re.o, re.b FROM re JOIN e s ON s.m = re.m AND s.k = src AND s.new JOIN e d ON d.m = re.m AND d.k = dst AND d.o = s.o AND d.event_type IN ('click', 'purchase') WHERE s_kept AND d_free),
lo AS (SELECT DISTINCT mb.m, mb.o, mb.b FROM mb JOIN ed ON ed.m = mb.m AND ed.dst = mb.k AND dep = 'control' AND src > 0 LEFT JOIN mb x ON x.m = mb.m AND x.o = mb.o AND x.b = mb.b AND x.k = src WHERE mb.kind = 'break' AND x.k IS NULL),
de AS (SELECT DISTINCT mb.m, mb.o, mb.b FROM mb JOIN anc ON anc.m = mb.m AND a = mb.k JOIN e ON e.m = anc.m AND e.k = anc.k AND e.kind = 'exit'),
ret AS (SELECT DISTINCT m, o FROM e WHERE kind = 'exit'),
n AS (SELECT m, o, b, count(*) AS n, count_if(kept) AS dup, count_if(kind = 'exit') AS exits, count_if(criterion AND NOT kept) AS free, bool_or(declared AND eo = o) AS declared, bool_or(declared AND eo = o AND kept) AS declared_kept, bool_or(kind = 'try' AND eo = o) AS closes FROM mb GROUP BY ALL),
r AS (SELECT n.m AS method, n.o AS variable, n.b AS block, n = ms OR (n = ms - 1 AND all_exits > exits) AS whole_body, n = 1 OR (n = 2 AND n.declared) AS minimum_size, declared_kept AS declaration_duplicated, ret.m IS NOT NULL AS variable_returned, free = 0 AS criteria_duplicated,
  de.m IS NOT NULL OR exits > 0 AS exit_depends, exits > 0 AS holds_exit, ch.m IS NOT NULL AS duplicated_state_change, an.m IS NOT NULL AS anti_dependence, ou.m IS NOT NULL AS output_dependence, cr.m IS NOT NULL AS duplicated_creation,
  n < {T.min_slice} OR n > ms - {T.max_slice_slack} OR dup > {T.max_duplication} OR dup / n > {T.max_duplication_ratio} AS over_thresholds, lo.m IS NOT NULL AS branch_without_loop, n.declared AND closes AS criterion_closed, cl.m IS NOT NULL AS declaration_closed
  FROM n JOIN size ON size.m = n.m LEFT JOIN ret ON ret.m = n.m AND ret.o = n.o {' '.join(f'LEFT JOIN {x} ON {x}.m = n.m AND {x}.o = n.o AND {x}.b = n.b' for x in ('de', 'ch', 'an', 'ou', 'cr', 'lo', 'cl'))})
SELECT *, NOT ({' OR '.join(slices.OBJECT_SLICE)}) AS applicable FROM r""")
def object_slice_rules(spark, d):
    """The fifteen rules over every such slice."""
    return slices.whole_method_rules(_methods(spark, d), T).select("method", "variable", "block", *slices.OBJECT_SLICE, "applicable")
