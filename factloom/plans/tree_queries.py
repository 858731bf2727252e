"""Registered queries of trees, expressions and their matching, with their SQL.

Roles: a user is a method and the user's events, in order of time, are its statements. Event k stands below the nearest of the
events k/2, k/4, ... that can hold others: views are `if`s, clicks loops, errors try blocks; purchases are ternaries and
sign-ups plain statements. An event of odd number runs in the false branch.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import effects, matching, trees
from ..operators.flow import control_edges
from ..operators.graph import settled
from ..sources.tables import table
from .catalogue import query

KIND = "CASE event_type WHEN 'view' THEN 'if' WHEN 'click' THEN 'for' WHEN 'error' THEN 'try' WHEN 'purchase' THEN 'ternary' ELSE 'statement' END"
#: Heap positions have fewer than this many binary digits.
DIGITS = 20


def _statements(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("g"), F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("id"), F.expr(KIND).alias("kind"), "value")
    holder = e.filter(F.col("kind").isin("if", "for", "try")).select("g", F.col("id").alias("up"))
    ups = e.select("g", "id", F.explode(F.sequence(F.lit(1), F.lit(DIGITS))).alias("i")).select("g", "id", F.expr("shiftright(id, i)").alias("up")).filter("up > 0")
    parent = ups.join(holder.hint("merge"), ["g", "up"]).groupBy("g", "id").agg(F.max("up").alias("parent"))
    x = e.join(parent.hint("merge"), ["g", "id"], "left")
    return x.select("g", "id", "parent", "kind", (F.col("id") % 2 == 1).alias("on_false"), F.col("kind").alias("form"), F.floor(F.col("value") / 10).cast("string").alias("text"))


_TREE = f"""
e AS (SELECT user_id AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, {KIND} AS kind FROM events),
p AS (SELECT a.g, a.k, max(h.k) AS up FROM (SELECT g, k, unnest(range(1, {DIGITS + 1})) AS i FROM e) a JOIN e h ON h.g = a.g AND h.k = a.k >> a.i AND h.kind IN ('if', 'for', 'try') GROUP BY 1, 2),
x AS (SELECT *, below AND kind = 'if' AND sum(below::INT) OVER (PARTITION BY g, up) = 1 AS else_if
  FROM (SELECT e.g, e.k, e.kind, coalesce(p.up, 0) AS up, coalesce(h.kind = 'if' AND e.k % 2 = 1, false) AS below FROM e LEFT JOIN p ON p.g = e.g AND p.k = e.k LEFT JOIN e h ON h.g = p.g AND h.k = p.up)),
c AS (SELECT g, k, up AS top FROM x WHERE else_if UNION ALL SELECT c.g, c.k, x.up FROM c JOIN x ON x.g = c.g AND x.k = c.top WHERE x.else_if),
top AS (SELECT c.g, c.k, c.top FROM c JOIN x ON x.g = c.g AND x.k = c.top WHERE NOT x.else_if),
own AS (SELECT * FROM x WHERE kind IN ('if', 'for', 'ternary') OR (kind = 'try' AND EXISTS (SELECT 1 FROM x y WHERE y.g = x.g AND y.up = x.k))),
nodes AS (SELECT g, k AS node, CASE WHEN below THEN -up ELSE up END AS parent, kind AS form, NULL::BIGINT AS if_parent FROM own WHERE NOT else_if
  UNION ALL SELECT own.g, own.k, CASE WHEN t.below THEN -t.up ELSE t.up END, own.kind, own.up FROM own JOIN top ON top.g = own.g AND top.k = own.k JOIN x t ON t.g = top.g AND t.k = top.top WHERE own.else_if),
every AS (SELECT * FROM nodes UNION ALL SELECT n.g, -n.node, n.parent, 'else of ' || n.form, n.node FROM nodes n WHERE EXISTS (SELECT 1 FROM x WHERE x.g = n.g AND x.up = n.node AND x.below AND NOT x.else_if)),
up AS (SELECT g, node, parent AS above, 1 AS steps FROM every UNION ALL SELECT up.g, up.node, e.parent, up.steps + 1 FROM up JOIN every e ON e.g = up.g AND e.node = up.above),
levels AS (SELECT g, node, max(steps)::INT AS level FROM up GROUP BY 1, 2),
sizes AS (SELECT g, above AS node, count(*) AS below FROM up GROUP BY 1, 2),
tree AS (SELECT e.g, e.node, e.parent, l.level, e.form, e.if_parent, coalesce(s.below, 0) + 1 AS size FROM every e JOIN levels l ON l.g = e.g AND l.node = e.node LEFT JOIN sizes s ON s.g = e.g AND s.node = e.node
  UNION ALL SELECT g, 0, NULL, 0, 'entry', NULL, 1 + (SELECT count(*) FROM every v WHERE v.g = u.g) FROM (SELECT DISTINCT g FROM e) u)"""


def _shapes(spark, d):
    return trees.shaped(trees.control_trees(_statements(spark, d)))


@query(f"WITH RECURSIVE {_TREE} SELECT g, node, parent, level, form, if_parent, size FROM tree")
def control_trees(spark, d):
    """The control-dependence tree of every user's events."""
    return _shapes(spark, d).select("g", "node", "parent", "level", "form", "if_parent", "size")


@query(f"""WITH RECURSIVE {_TREE},
link AS (SELECT g, node, if_parent AS head FROM tree WHERE if_parent IS NOT NULL UNION ALL SELECT l.g, l.node, t.if_parent FROM link l JOIN tree t ON t.g = l.g AND t.node = l.head WHERE t.if_parent IS NOT NULL),
heads AS (SELECT l.g, l.node, l.head FROM link l JOIN tree t ON t.g = l.g AND t.node = l.head WHERE t.if_parent IS NULL),
chains AS (SELECT * FROM heads UNION SELECT g, head, head FROM heads),
liked AS (SELECT t.*, CASE WHEN c.head IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY t.g, c.head) END || '|' || t.form AS like_ FROM tree t LEFT JOIN chains c ON c.g = t.g AND c.node = t.node),
nths AS (SELECT *, row_number() OVER (PARTITION BY g, parent, like_ ORDER BY abs(node), node DESC) AS nth FROM liked),
walk AS (SELECT g, node, node AS head, 0 AS depth, [''] AS path FROM nths WHERE node <> 0
  UNION ALL SELECT w.g, n.node, w.head, w.depth + 1, list_append(w.path, n.like_ || '#' || lpad(n.nth::VARCHAR, 6, '0')) FROM walk w JOIN nths n ON n.g = w.g AND n.parent = w.node),
shapes AS (SELECT w.g, w.head AS node, string_agg(w.depth || ':' || n.like_, ',' ORDER BY w.path) AS shape FROM walk w JOIN nths n ON n.g = w.g AND n.node = w.node GROUP BY 1, 2),
-- Children of an entry have a context each.
ctx AS (SELECT n.g, n.node, n.size, s.shape, CASE WHEN n.parent = 0 THEN 'top/' || n.g || '/' || n.node ELSE a.shape || '/' || n.like_ || '/' || n.nth END AS context
  FROM nths n JOIN shapes s ON s.g = n.g AND s.node = n.node LEFT JOIN shapes a ON a.g = n.g AND a.node = n.parent),
many AS (SELECT shape, count(DISTINCT context) AS contexts, count(*) AS members, min({{'g': g, 'node': node}}) AS least FROM ctx WHERE size >= 2 GROUP BY 1 HAVING count(DISTINCT context) > 1)
SELECT c.g, c.node, c.size, m.least.g AS class_g, m.least.node AS class_node, m.members, m.contexts FROM ctx c JOIN many m ON m.shape = c.shape WHERE c.size >= 2""")
def like_subtrees(spark, d):
    """Sub-trees of two and more nodes that match another one whole, as classes named by their least node."""
    x = trees.like_subtrees(_shapes(spark, d), 2)
    by = x.groupBy("shape").agg(F.min(F.struct("g", "node")).alias("least"), F.count(F.lit(1)).alias("members"), F.count_distinct("context").alias("contexts"))
    return x.join(by, "shape").select("g", "node", "size", F.col("least.g").alias("class_g"), F.col("least.node").alias("class_node"), "members", "contexts")


def _neighbours(shapes):
    g = shapes.select("g").distinct()
    return g.select(F.col("g").alias("pair"), F.col("g").alias("g1"), (F.col("g") + 1).alias("g2")).join(g.select(F.col("g").alias("g2")), "g2", "left_semi")


@query()
def tree_matches(spark, d):
    """Bottom-up matches of the trees of users with consecutive numbers."""
    shapes = _shapes(spark, d)
    return trees.bottom_up(_neighbours(shapes), shapes)


@query()
def ranked_tree_matches(spark, d):
    """Those matches by size."""
    shapes = _shapes(spark, d)
    return trees.rank_matches(trees.bottom_up(_neighbours(shapes), shapes))


@query()
def mapped_statements(spark, d):
    """Plain statements (sign-ups) below the matched nodes of those trees, mapped level by level by value."""
    s = settled(_statements(spark, d))
    shapes = trees.shaped(trees.control_trees(s))
    pairs = _neighbours(shapes)
    level = shapes.select(F.col("g").alias("g1"), F.col("node").alias("a"), "level")
    matches = trees.bottom_up(pairs, shapes).join(pairs, "pair").join(level, ["g1", "a"])
    at = shapes.select("g", "node")
    plain = s.filter("kind = 'statement'").join(s.select("g", F.col("id").alias("parent"), (F.col("kind") == "if").alias("under_if")), ["g", "parent"])
    node = F.when(F.col("under_if") & F.col("on_false"), -F.col("parent")).otherwise(F.col("parent"))
    rows = plain.select("g", "id", node.alias("node"), "form", "text", F.array(F.col("id") - 1, F.col("id") - 2).alias("deps")).join(at, ["g", "node"], "left_semi")
    return trees.map_levels(matches, rows)


_BANDS = "CASE event_type WHEN 'error' THEN 'name' WHEN 'purchase' THEN 'literal' WHEN 'signup' THEN 'infix' ELSE 'call' END"


def _nodes(spark, d):
    """Each user's events as an expression: event k is a child of event k/2, its place there k mod 2."""
    e = table(spark, d, "events").select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("k"), F.expr(_BANDS).alias("kind"), "value")
    band = F.floor(F.col("value") / 40)
    return e.select(F.col("user_id").alias("e"), F.col("k").alias("node"), F.when(F.col("k") > 1, F.expr("shiftright(k, 1)")).alias("parent"), (F.col("k") % 2).alias("position"), "kind", F.floor(F.col("value") / 15).cast("string").alias("value"), F.least(band, F.lit(3)).cast("string").alias("type"), F.when(band > 0, F.lit("s")).alias("super"))


_NODES = f"""
n AS (SELECT user_id AS e, k AS node, CASE WHEN k > 1 THEN k >> 1 END AS parent, k % 2 AS position, kind, CAST(floor(value / 15) AS BIGINT)::VARCHAR AS value, least(floor(value / 40), 3)::BIGINT::VARCHAR AS type, CASE WHEN floor(value / 40) > 0 THEN 's' END AS super
  FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, {_BANDS} AS kind, value FROM events)),
a AS (SELECT e, node, node AS anc FROM n UNION ALL SELECT a.e, a.node, a.anc >> 1 FROM a WHERE a.anc > 1),
s AS (SELECT e, anc AS node, count(*) AS size FROM a GROUP BY 1, 2),
-- A heap's nodes have children 2k (place 0, a call's receiver) and 2k + 1 (place 1); only a call's place 1 must agree in number.
x AS (SELECT n.*, s.size, l.node IS NOT NULL AS receiver, (n.kind = 'call' AND r.node IS NOT NULL)::INT AS counted FROM n JOIN s USING (e, node) LEFT JOIN n l ON l.e = n.e AND l.node = 2 * n.node LEFT JOIN n r ON r.e = n.e AND r.node = 2 * n.node + 1),
u AS (SELECT DISTINCT e FROM n),
m AS (SELECT u.e AS pair, u.e AS e1, v.e AS e2, 1::BIGINT AS node FROM u JOIN u v ON v.e = u.e + 1
  UNION ALL SELECT m.pair, m.e1, m.e2, c.node FROM m JOIN x p ON p.e = m.e1 AND p.node = m.node JOIN x q ON q.e = m.e2 AND q.node = m.node AND q.kind = p.kind
  JOIN n c ON c.e = m.e1 AND c.parent = m.node JOIN n b ON b.e = m.e2 AND b.node = c.node WHERE c.position = 0 OR p.counted = q.counted),
b AS (SELECT m.pair, m.node, p.kind AS kind, p.kind = q.kind AS same, p.value AS v1, q.value AS v2, p.type = q.type AS typed, coalesce(p.type <> q.type AND p.super = q.super, false) AS akin, p.counted <> q.counted AS number, p.receiver <> q.receiver AS receiver, greatest(p.size, q.size) AS size
  FROM m JOIN x p ON p.e = m.e1 AND p.node = m.node JOIN x q ON q.e = m.e2 AND q.node = m.node),
diff AS (
  SELECT pair, node, CASE kind WHEN 'name' THEN 'VARIABLE_NAME_MISMATCH' WHEN 'literal' THEN 'LITERAL_VALUE_MISMATCH' WHEN 'call' THEN 'METHOD_INVOCATION_NAME_MISMATCH' ELSE 'OPERATOR_MISMATCH' END AS kind, 1::BIGINT AS weight, v1, v2 FROM b WHERE same AND v1 <> v2
  UNION ALL SELECT pair, node, 'VARIABLE_TYPE_MISMATCH', 1, v1, v2 FROM b WHERE same AND NOT typed AND NOT akin
  UNION ALL SELECT pair, node, 'SUBCLASS_TYPE_MISMATCH', 1, v1, v2 FROM b WHERE akin
  UNION ALL SELECT pair, node, 'ARGUMENT_NUMBER_MISMATCH', 1, v1, v2 FROM b WHERE same AND number
  UNION ALL SELECT pair, node, 'MISSING_METHOD_INVOCATION_EXPRESSION', 1, v1, v2 FROM b WHERE same AND kind = 'call' AND receiver
  UNION ALL SELECT pair, node, 'TYPE_COMPATIBLE_REPLACEMENT', size, v1, v2 FROM b WHERE NOT same AND (typed OR akin)
  UNION ALL SELECT pair, node, 'AST_TYPE_MISMATCH', 1, v1, v2 FROM b WHERE NOT same AND NOT typed AND NOT akin)"""


def _expression_pairs(nodes):
    e = nodes.select("e").distinct()
    return e.select(F.col("e").alias("pair"), F.col("e").alias("e1"), (F.col("e") + 1).alias("e2")).join(e.select(F.col("e").alias("e2")), "e2", "left_semi")


@query(f"WITH RECURSIVE {_NODES} SELECT pair, node AS n1, node AS n2, kind, weight, v1 AS \"left\", v2 AS \"right\", v1 || ' / ' || v2 AS difference FROM diff")
def expression_differences(spark, d):
    """The differences of the expressions of users with consecutive numbers."""
    nodes = _nodes(spark, d)
    return matching.match_expressions(_expression_pairs(nodes), nodes)


@query(f"""WITH RECURSIVE {_NODES},
g AS (SELECT p.pair, count(kind) AS n, count_if(kind IN ('ARGUMENT_NUMBER_MISMATCH', 'MISSING_METHOD_INVOCATION_EXPRESSION', 'TYPE_COMPATIBLE_REPLACEMENT', 'AST_TYPE_MISMATCH', 'OPERATOR_MISMATCH')) AS heavy, coalesce(bool_or(kind = 'VARIABLE_NAME_MISMATCH'), false) AS names,
  coalesce(bool_or(kind = 'METHOD_INVOCATION_NAME_MISMATCH'), false) AS calls, coalesce(bool_or(kind LIKE 'MISSING%'), false) AS receiver, coalesce(bool_or(kind IN ('ARGUMENT_NUMBER_MISMATCH', 'TYPE_COMPATIBLE_REPLACEMENT')), false) AS args, coalesce(bool_or(kind IN ('AST_TYPE_MISMATCH', 'VARIABLE_TYPE_MISMATCH')), false) AS types
  FROM (SELECT DISTINCT pair FROM m) p LEFT JOIN diff ON diff.pair = p.pair GROUP BY 1)
SELECT pair, NOT types AS matches, (n > 0 AND heavy = 0 AND NOT (names AND calls)) OR (NOT (receiver AND calls AND args) AND NOT types) AS parameterizable FROM g""")
def parameterizable_pairs(spark, d):
    """Whether parameters can take up all differences of those expressions."""
    nodes = _nodes(spark, d)
    pairs = _expression_pairs(nodes)
    return matching.parameterizable(pairs, matching.match_expressions(pairs, nodes))


@query("""WITH v AS (SELECT user_id AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, event_type || CAST(floor(value / 25) AS BIGINT) AS v FROM events),
n AS (SELECT a.g AS pair, a.v AS v1, b.v AS v2, count(*) AS uses FROM v a JOIN v b ON b.g = a.g + 1 AND b.k = a.k GROUP BY ALL)
SELECT *, v1 <> v2 AND count(*) OVER (PARTITION BY pair, v1) = 1 AND count(*) OVER (PARTITION BY pair, v2) = 1 AS renamed FROM n""")
def renamed_variables(spark, d):
    """Names (type and band of an event) that stand in the same places of consecutive users' events."""
    k = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    v = table(spark, d, "events").select(F.col("user_id").alias("g"), k.alias("k"), F.concat("event_type", F.floor(F.col("value") / 25).cast("string")).alias("v"))
    other = v.select((F.col("g") - 1).alias("g"), "k", F.col("v").alias("v2"))
    return matching.renamed_variables(v.join(other, ["g", "k"]).select(F.col("g").alias("pair"), F.col("v").alias("v1"), "v2"))


@query("""WITH RECURSIVE v AS (SELECT user_id AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, event_type, value FROM events),
s AS (SELECT g, k, event_type = 'view' AND value > 60 AS mapped FROM v),
e AS (SELECT g, k >> 1 AS src, k AS dst FROM v WHERE value > 30 AND k > 1 UNION SELECT g, k - 5, k FROM v WHERE event_type = 'click' AND k > 5),
down AS (SELECT e.g, e.dst AS k FROM e JOIN s a ON a.g = e.g AND a.k = e.src AND a.mapped JOIN s b ON b.g = e.g AND b.k = e.dst AND NOT b.mapped
  UNION SELECT e.g, e.dst FROM down JOIN e ON e.g = down.g AND e.src = down.k JOIN s b ON b.g = e.g AND b.k = e.dst AND NOT b.mapped),
up AS (SELECT e.g, e.src AS k FROM e JOIN s a ON a.g = e.g AND a.k = e.dst AND a.mapped JOIN s b ON b.g = e.g AND b.k = e.src AND NOT b.mapped
  UNION SELECT e.g, e.src FROM up JOIN e ON e.g = up.g AND e.dst = up.k JOIN s b ON b.g = e.g AND b.k = e.src AND NOT b.mapped)
SELECT s.g, s.k AS node, down.k IS NULL AS before, up.k IS NULL AS after FROM s LEFT JOIN down ON down.g = s.g AND down.k = s.k LEFT JOIN up ON up.g = s.g AND up.k = s.k WHERE NOT s.mapped""")
def movable_statements(spark, d):
    """Where the events that aren't mapped (views beyond 60 are) can move, by dependences between them."""
    k = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    v = table(spark, d, "events").select(F.col("user_id").alias("g"), k.alias("node"), "event_type", "value")
    near = v.filter("value > 30 AND node > 1").select("g", F.expr("shiftright(node, 1)").alias("src"), F.col("node").alias("dst"))
    far = v.filter("event_type = 'click' AND node > 5").select("g", (F.col("node") - 5).alias("src"), F.col("node").alias("dst"))
    return matching.movable(v.select("g", "node", ((F.col("event_type") == "view") & (F.col("value") > 60)).alias("mapped")), near.unionByName(far))


def _flow(spark, d):
    """A user's events as a method: event k runs into the next one, views also into event 2k, clicks back to event k/2; each but
    errors assigns one of six variables to another, and errors assign a new object."""
    k = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    e = settled(table(spark, d, "events").select(F.col("user_id").alias("g"), k.alias("node"), "event_type", F.floor("value").cast("long").alias("v")))
    last = e.groupBy("g").agg(F.max("node").alias("last"))
    x = e.join(last, "g")
    to = F.array(F.col("node") + 1, F.when(F.col("event_type") == "view", 2 * F.col("node")), F.when(F.col("event_type") == "click", F.expr("shiftright(node, 1)")))
    flow = x.select("g", F.col("node").alias("src"), F.explode(to).alias("dst"), "last").filter("dst BETWEEN 1 AND last").drop("last").distinct()
    name = lambda c: F.concat(F.lit("v"), (c % 6).cast("string"))
    assigns = e.select("g", "node", name(F.col("v")).alias("left"), F.when(F.col("event_type") != "error", name(F.floor(F.col("v") / 7))).alias("right"))
    field = lambda of: e.filter(f"event_type = '{of}'").select("g", "node", name(F.floor(F.col("v") / 5)).alias("var"), F.concat(F.lit("f"), (F.col("v") % 2).cast("string")).alias("field"))
    return flow, assigns, field("signup"), field("purchase")


_FLOW = """
e AS (SELECT user_id AS g, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS node, event_type, CAST(floor(value) AS BIGINT) AS v FROM events),
flow AS (SELECT DISTINCT x.g, x.node AS src, y.node AS dst FROM e x JOIN e y ON y.g = x.g AND (y.node = x.node + 1 OR (x.event_type = 'view' AND y.node = 2 * x.node) OR (x.event_type = 'click' AND y.node = x.node >> 1))),
asg AS (SELECT g, node, 'v' || v % 6 AS x, CASE WHEN event_type <> 'error' THEN 'v' || (v // 7) % 6 END AS y FROM e),
al AS (SELECT g, node, least(x, y) AS a, greatest(x, y) AS b FROM asg WHERE x <> y
  UNION SELECT f.g, f.dst, least(n.p, n.q), greatest(n.p, n.q) FROM al JOIN flow f ON f.g = al.g AND f.src = al.node JOIN asg s ON s.g = f.g AND s.node = f.dst,
    LATERAL (SELECT al.a AS p, al.b AS q WHERE s.x IS NOT DISTINCT FROM s.y OR s.x NOT IN (al.a, al.b)
      UNION ALL SELECT s.x, CASE WHEN s.y = al.a THEN al.b ELSE al.a END WHERE s.y IN (al.a, al.b) AND s.x NOT IN (al.a, al.b)) n)"""


@query(f"WITH RECURSIVE {_FLOW} SELECT g, node, a, b FROM al")
def alias_sets(spark, d):
    """Variables that may be aliases after each event."""
    flow, assigns, _, _ = _flow(spark, d)
    return effects.alias_pairs(flow, assigns)


@query(f"""WITH RECURSIVE {_FLOW},
wr AS (SELECT g, node, 'v' || (v // 5) % 6 AS var, 'f' || v % 2 AS field FROM e WHERE event_type = 'signup'),
rd AS (SELECT g, node, 'v' || (v // 5) % 6 AS var, 'f' || v % 2 AS field FROM e WHERE event_type = 'purchase'),
born AS (SELECT g, node AS d, var, field FROM wr UNION SELECT wr.g, wr.node, CASE WHEN al.a = wr.var THEN al.b ELSE al.a END, wr.field FROM wr JOIN al ON al.g = wr.g AND al.node = wr.node AND wr.var IN (al.a, al.b)),
held AS (SELECT g, d AS node, d, var, field FROM born
  UNION SELECT f.g, f.dst, h.d, n.v, h.field FROM held h JOIN flow f ON f.g = h.g AND f.src = h.node JOIN asg s ON s.g = f.g AND s.node = f.dst LEFT JOIN wr ON wr.g = f.g AND wr.node = f.dst AND wr.var = h.var AND wr.field = h.field,
    LATERAL (SELECT h.var AS v WHERE s.x <> h.var OR s.y IS NOT DISTINCT FROM h.var UNION ALL SELECT s.x WHERE s.x <> h.var AND s.y = h.var) n WHERE wr.g IS NULL)
SELECT DISTINCT h.g, h.d AS src, f.dst, h.var, h.field FROM held h JOIN flow f ON f.g = h.g AND f.src = h.node JOIN rd ON rd.g = f.g AND rd.node = f.dst AND rd.var = h.var AND rd.field = h.field""")
def aliased_dependences(spark, d):
    """Fields read by purchases that sign-ups may have written, through aliases too."""
    return effects.aliased_dependences(*_flow(spark, d))


_CALLS = """
l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem),
bind AS (SELECT DISTINCT a.l_partkey AS caller, b.l_partkey AS callee, CASE a.l_returnflag WHEN 'A' THEN 'this' WHEN 'R' THEN 'p1' ELSE 'p2' END AS slot, CASE a.l_linestatus WHEN 'O' THEN 'this' ELSE 'p1' END AS root, CASE WHEN a.l_suppkey % 3 > 0 THEN ['f' || a.l_suppkey % 3] ELSE [] END AS path
  FROM l a JOIN l b ON b.l_orderkey = a.l_orderkey AND b.k = a.k + 1 WHERE a.l_quantity >= 48),
direct AS (SELECT DISTINCT l_partkey AS method, CASE l_returnflag WHEN 'A' THEN 'this' WHEN 'R' THEN 'p1' ELSE 'p2' END AS root, ['g' || l_suppkey % 3] AS path, CASE l_linestatus WHEN 'F' THEN 'write' ELSE 'read' END AS mode FROM lineitem WHERE l_quantity = 1),
eff AS (SELECT method, root, path, mode, 0 AS calls FROM direct UNION SELECT b.caller, b.root, list_concat(b.path, e.path), e.mode, e.calls + 1 FROM eff e JOIN bind b ON b.callee = e.method AND b.slot = e.root WHERE e.calls < 3 AND len(b.path) + len(e.path) <= 3)"""


@query(f"WITH RECURSIVE {_CALLS} SELECT method, root, array_to_string(path, '.') AS path, mode, min(calls) AS calls FROM eff GROUP BY ALL")
def side_effects(spark, d):
    """Fields that parts (methods) touch, where a part calls the one on the next line of an order."""
    li = table(spark, d, "lineitem")
    at = F.when(F.col("l_returnflag") == "A", "this").when(F.col("l_returnflag") == "R", "p1").otherwise("p2")
    x = li.withColumn("callee", F.lead("l_partkey").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")))
    third = (F.col("l_suppkey") % 3).cast("string")
    path = F.when(F.col("l_suppkey") % 3 > 0, F.array(F.concat(F.lit("f"), third))).otherwise(F.array().cast("array<string>"))
    bind = x.filter("l_quantity >= 48 AND callee IS NOT NULL").select(F.col("l_partkey").alias("caller"), "callee", at.alias("slot"), F.when(F.col("l_linestatus") == "O", "this").otherwise("p1").alias("root"), path.alias("path"))
    direct = li.filter("l_quantity = 1").select(F.col("l_partkey").alias("method"), at.alias("root"), F.array(F.concat(F.lit("g"), third)).alias("path"), F.when(F.col("l_linestatus") == "F", "write").otherwise("read").alias("mode"))
    return effects.side_effects(direct, bind).withColumn("path", F.array_join("path", "."))


@query(f"""WITH RECURSIVE {_FLOW.split('asg AS')[0].rstrip().rstrip(',')},
g AS (SELECT f.g, f.src, f.dst, CASE WHEN f.dst = f.src + 1 THEN 'next' ELSE 'jump' END AS branch FROM flow f UNION ALL SELECT g, 0, 1, NULL FROM (SELECT DISTINCT g FROM e) UNION ALL SELECT g, max(node), -1, NULL FROM e GROUP BY 1
  UNION ALL SELECT g, 0, -1, 'out' FROM (SELECT DISTINCT g FROM e)),
n AS (SELECT g, node FROM e UNION ALL SELECT DISTINCT g, 0 FROM e UNION ALL SELECT DISTINCT g, -1 FROM e),
-- y reaches the exit without passing x
around AS (SELECT n.g, n.node AS x, -1::BIGINT AS y FROM n WHERE n.node <> -1 UNION SELECT a.g, a.x, g.src FROM around a JOIN g ON g.g = a.g AND g.dst = a.y WHERE g.src <> a.x)
SELECT DISTINCT f.g, f.src, x.node AS dst, f.branch FROM g f JOIN n x ON x.g = f.g AND x.node <> -1
WHERE coalesce(f.branch, '') <> 'out' AND NOT EXISTS (SELECT 1 FROM around a WHERE a.g = f.g AND a.x = x.node AND a.y = f.dst)
  AND (x.node = f.src OR EXISTS (SELECT 1 FROM around a WHERE a.g = f.g AND a.x = x.node AND a.y = f.src))""")
def control_dependences(spark, d):
    """Control dependences of users' events by post-dominance over that flow with its jumps."""
    flow, assigns, _, _ = _flow(spark, d)
    branch = F.when(F.col("dst") == F.col("src") + 1, "next").otherwise("jump")
    none = F.lit(None).cast("string").alias("branch")
    ends = assigns.groupBy("g").agg(F.max("node").alias("last"))
    zero, out = F.lit(0).cast("long"), F.lit(-1).cast("long")
    rows = flow.select("g", "src", "dst", branch.alias("branch")).unionByName(ends.select("g", zero.alias("src"), F.lit(1).cast("long").alias("dst"), none)).unionByName(ends.select("g", F.col("last").alias("src"), out.alias("dst"), none))
    return control_edges(rows)
