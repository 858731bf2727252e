"""The registered queries: name -> function of (spark, folder), and the same result in SQL.

Roles: a supplier is a class, a part it sells is an attribute, an order is a method; a customer is an entity that uses
suppliers of nations; users' events are the nodes of a straight flow; documents' texts are code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import edits, names, sets
from ..operators import candidates, clones, cluster, evolution, facts, flow, graph, joins, metrics
from ..sources.reports import line_offsets
from ..sources.tables import partitions_for, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


def _sells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()


# --- sets and distances

_PAIRS = """
sells AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem),
sizes AS (SELECT s, count(*) AS n FROM sells GROUP BY s),
pairs AS (SELECT a.s AS a, b.s AS b, count(*) AS c FROM sells a JOIN sells b ON a.p = b.p AND a.s < b.s GROUP BY a.s, b.s)
"""


@query(f"WITH {_PAIRS} SELECT a, b, c::BIGINT AS common, round(1.0 - c::DOUBLE / (x.n + y.n - c), 6) AS distance FROM pairs JOIN sizes x ON x.s = a JOIN sizes y ON y.s = b")
def jaccard_supplier_pairs(spark, d):
    """Jaccard distances of suppliers by the parts they sell, through shared parts."""
    n = _sells(spark, d).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    c = sets.common_counts(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")), "s", "p")
    out = c.join(n.select(F.col("s").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("s").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", "common", r6(sets.distance_of_sizes(F.col("common"), F.col("na"), F.col("nb"))).alias("distance"))


def _arrays(spark, d):
    """Each customer's nations of suppliers and own nation, as two small sets."""
    li, o, s, c = (table(spark, d, n) for n in ("lineitem", "orders", "supplier", "customer"))
    used = li.join(s, li["l_suppkey"] == s["s_suppkey"]).join(o, li["l_orderkey"] == o["o_orderkey"]).groupBy(F.col("o_custkey").alias("k")).agg(F.array_sort(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("s_nationkey")))).alias("a"), F.array_sort(F.collect_set(F.when(F.col("l_returnflag") != "R", F.col("s_nationkey")))).alias("b"))
    return used.join(c.select(F.col("c_custkey").alias("k")), "k", "left_semi")


_ARRAYS = """
u AS (SELECT o_custkey AS k, s_nationkey AS n, l_returnflag = 'R' AS r FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey),
a AS (SELECT DISTINCT k, n FROM u WHERE r), b AS (SELECT DISTINCT k, n FROM u WHERE NOT r)
"""
_JOINED = "string_agg(CAST(n AS VARCHAR), ',' ORDER BY n)"


def _joined(x):
    return F.array_join(F.transform(F.array_sort(x), lambda e: e.cast("string")), ",")


def _set_sql(op: str) -> str:
    return f"WITH {_ARRAYS}, ks AS (SELECT DISTINCT k FROM u), x AS (SELECT k, n FROM a {op} SELECT k, n FROM b) SELECT ks.k, coalesce({_JOINED}, '') AS nations FROM ks LEFT JOIN x ON x.k = ks.k GROUP BY ks.k"


@query(_set_sql("UNION"))
def set_union(spark, d):
    return _arrays(spark, d).select("k", _joined(sets.union(F.col("a"), F.col("b"))).alias("nations"))


@query(_set_sql("INTERSECT"))
def set_intersect(spark, d):
    return _arrays(spark, d).select("k", _joined(sets.intersection(F.col("a"), F.col("b"))).alias("nations"))


@query(_set_sql("EXCEPT"))
def set_except(spark, d):
    return _arrays(spark, d).select("k", _joined(sets.difference(F.col("a"), F.col("b"))).alias("nations"))


@query("SELECT k, count(*)::BIGINT AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k")
def set_union_all(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    return sets.union_rows(a, b, bag=True).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_ARRAYS}, i AS (SELECT k, count(*) AS c FROM (SELECT * FROM a INTERSECT SELECT * FROM b) GROUP BY k), j AS (SELECT k, count(*) AS c FROM (SELECT * FROM a UNION SELECT * FROM b) GROUP BY k) SELECT j.k, round(1.0 - coalesce(i.c, 0)::DOUBLE / j.c, 6) AS distance FROM j LEFT JOIN i ON i.k = j.k")
def set_jaccard(spark, d):
    return _arrays(spark, d).select("k", r6(sets.jaccard_distance(F.col("a"), F.col("b"))).alias("distance"))


@query("WITH x AS (SELECT DISTINCT s_nationkey AS nation, s_suppkey AS s, l_partkey AS p FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), n AS (SELECT s_nationkey AS nation, count(DISTINCT s_suppkey) AS c FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1) SELECT x.nation, x.p AS part FROM x JOIN n ON n.nation = x.nation GROUP BY x.nation, x.p, n.c HAVING count(*) = n.c")
def nway_intersection(spark, d):
    """Parts that every supplier of a nation sells."""
    li, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    x = li.join(s, li["l_suppkey"] == s["s_suppkey"]).select(F.col("s_nationkey").alias("nation"), F.col("l_partkey").alias("part"), F.col("s_suppkey").alias("s")).distinct()
    return joins.divide(x, "part", "s", x.select("nation", "s"), by="nation").select("nation", "part")


# --- metrics

_LCOM = """
x AS (SELECT DISTINCT l_suppkey AS class, l_orderkey AS method, p_brand AS field FROM lineitem JOIN part ON l_partkey = p_partkey),
g AS (SELECT class, count(DISTINCT method) AS m, count(DISTINCT field) AS a, count(*) AS u FROM x GROUP BY class)
"""


def _lcom(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    x = li.join(p, li["l_partkey"] == p["p_partkey"]).select(F.col("l_suppkey").alias("class"), F.col("l_orderkey").alias("method"), F.col("p_brand").alias("field")).distinct()
    return metrics.lack_of_cohesion(x, x, x)


@query(f"WITH {_LCOM} SELECT class, round(1 - u::DOUBLE / (m * a), 6) AS lcom2 FROM g")
def lcom2_by_class(spark, d):
    return _lcom(spark, d).select("class", r6("lcom2").alias("lcom2"))


@query(f"WITH {_LCOM} SELECT class, CASE WHEN m > 1 THEN round((m - u::DOUBLE / a) / (m - 1), 6) END AS lcom3 FROM g")
def lcom3_by_class(spark, d):
    return _lcom(spark, d).select("class", r6("lcom3").alias("lcom3"))


@query(f"WITH {_LCOM} SELECT round(coalesce(avg(1 - u::DOUBLE / (m * a)), 0), 6) AS avg_lcom2 FROM g")
def system_avg_lcom(spark, d):
    return metrics.system_average(_lcom(spark, d), "lcom2", "avg_lcom2").select(r6("avg_lcom2").alias("avg_lcom2"))


_CONNECT = """
x AS (SELECT DISTINCT event_type AS class, user_id AS method, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS field FROM events),
n AS (SELECT class, count(DISTINCT method) AS m FROM x GROUP BY class),
c AS (SELECT class, count(*) AS c FROM (SELECT DISTINCT a.class, a.method, b.method AS other FROM x a JOIN x b ON a.class = b.class AND a.field = b.field AND a.method < b.method) GROUP BY class)
"""


def _connect(spark, d):
    x = table(spark, d, "events").select(F.col("event_type").alias("class"), F.col("user_id").alias("method"), F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("field"))
    return metrics.connectivity(x, x)


@query(f"WITH {_CONNECT} SELECT n.class, round(CASE WHEN m > 1 THEN 2.0 * coalesce(c, 0) / (m * (m - 1)) END, 6) AS connectivity FROM n LEFT JOIN c ON c.class = n.class")
def connectivity_by_class(spark, d):
    return _connect(spark, d).select("class", r6("connectivity").alias("connectivity"))


@query(f"WITH {_CONNECT} SELECT round(coalesce(avg(CASE WHEN m > 1 THEN 2.0 * coalesce(c, 0) / (m * (m - 1)) END), 0), 6) AS avg_connectivity FROM n LEFT JOIN c ON c.class = n.class")
def system_avg_connectivity(spark, d):
    return metrics.system_average(_connect(spark, d), "connectivity", "avg_connectivity").select(r6("avg_connectivity").alias("avg_connectivity"))


def _trade(spark, d):
    """A line item is an access from its customer's nation to its supplier's."""
    li, o, c, s = (table(spark, d, n) for n in ("lineitem", "orders", "customer", "supplier"))
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(s, li["l_suppkey"] == s["s_suppkey"]).select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"))


_TRADE = "trade AS (SELECT c_nationkey AS src, s_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"


def _nations(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("class"))


@query(f"WITH {_TRADE}, t AS (SELECT src, dst, count(*) AS n FROM trade GROUP BY src, dst) SELECT a.n_nationkey AS src, b.n_nationkey AS dst, coalesce(n, 0)::BIGINT AS n FROM nation a CROSS JOIN nation b LEFT JOIN t ON t.src = a.n_nationkey AND t.dst = b.n_nationkey")
def coupling_matrix(spark, d):
    return metrics.coupling_matrix(_nations(spark, d), _trade(spark, d))


_AVG = f"{_TRADE}, c AS (SELECT n_nationkey AS class, (SELECT count(*) FROM trade WHERE src = n_nationkey AND dst <> n_nationkey)::DOUBLE / ((SELECT count(*) FROM nation) - 1) AS coupling FROM nation)"


@query(f"WITH {_AVG} SELECT class, round(coupling, 6) AS coupling FROM c")
def coupling_avg(spark, d):
    return metrics.average_coupling(_nations(spark, d), _trade(spark, d)).select("class", r6("coupling").alias("coupling"))


@query(f"WITH {_AVG} SELECT round(coalesce(avg(coupling), 0), 6) AS avg_coupling FROM c")
def system_avg_coupling(spark, d):
    return metrics.system_average(metrics.average_coupling(_nations(spark, d), _trade(spark, d)), "coupling", "avg_coupling").select(r6("avg_coupling").alias("avg_coupling"))


@query("SELECT o_custkey AS k, count(DISTINCT CASE WHEN s_nationkey = c_nationkey THEN l_partkey END)::BIGINT AS source_deps, count(DISTINCT CASE WHEN s_nationkey <> c_nationkey THEN l_partkey END)::BIGINT AS target_deps, count(DISTINCT CASE WHEN s_nationkey = c_nationkey AND l_returnflag = 'R' THEN l_partkey END)::BIGINT AS internal_reads, count(DISTINCT CASE WHEN s_nationkey <> c_nationkey AND l_returnflag = 'R' THEN l_partkey END)::BIGINT AS external_reads FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY o_custkey")
def dependency_counts(spark, d):
    """Distinct internal and external dependencies of customers on parts, by mode."""
    li, o, c, s = (table(spark, d, n) for n in ("lineitem", "orders", "customer", "supplier"))
    mode = F.when(F.col("l_returnflag") == "R", "read").when(F.col("l_returnflag") == "A", "write").otherwise("call")
    n = partitions_for(li)
    a = li.repartition(n, "l_orderkey").join(o.join(c, o["o_custkey"] == c["c_custkey"]).repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(s, li["l_suppkey"] == s["s_suppkey"]).select(F.col("o_custkey").alias("k"), (F.col("s_nationkey") == F.col("c_nationkey")).alias("inside"), F.col("l_partkey").alias("member"), mode.alias("mode"))
    return metrics.dependencies(a.repartition(n, "k", "member"), ["k"]).select("k", "source_deps", "target_deps", "internal_reads", "external_reads")


@query("SELECT l_suppkey AS s, l_returnflag AS mode, p_brand AS member, count(*)::BIGINT AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3")
def dependency_histogram(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    return metrics.dependency_histogram(li.join(p, li["l_partkey"] == p["p_partkey"]).select(F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("mode"), F.col("p_brand").alias("member")), ["s"])


@query("SELECT c_nationkey AS nation, round(sum(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END) / count(*), 4) AS avg_balance, max(CASE WHEN c_acctbal > 0 THEN c_acctbal END) AS max_balance, count(CASE WHEN c_acctbal > 0 THEN 1 END)::BIGINT AS n_kept FROM customer GROUP BY 1")
def group_avgs_unfiltered_denominator(spark, d):
    x = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), (F.col("c_acctbal") > 0).alias("kept"))
    return metrics.group_averages(x, ["nation"], ["balance"], "kept").select("nation", F.round("avg_balance", 4).alias("avg_balance"), "max_balance", "n_kept")


@query("WITH x AS (SELECT o_orderpriority AS g, o_custkey AS class, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1, 2) SELECT g AS \"group\", sum(n)::BIGINT AS size_system, round(avg(n), 6) AS avg_size_class, round(sum(s) / sum(n), 3) AS avg_statements FROM x GROUP BY g")
def type_check_groups(spark, d):
    x = table(spark, d, "orders").select(F.col("o_orderpriority").alias("group"), F.col("o_custkey").alias("class"), F.col("o_orderkey").alias("candidate"), F.col("o_totalprice").alias("statements"))
    g = candidates.type_check_groups(x)
    return g.select("group", "size_system", r6("avg_size_class").alias("avg_size_class"), F.round("avg_statements", 3).alias("avg_statements"))


@query("SELECT b AS severity, count(*)::BIGINT AS customers FROM (SELECT CASE WHEN n <= 1 THEN 1 WHEN n = 2 THEN 2 WHEN n <= 4 THEN 3 WHEN n <= 6 THEN 4 ELSE 5 END AS b FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)) GROUP BY b")
def severity_buckets(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(names.severity(F.col("n")).alias("severity")).agg(F.count(F.lit(1)).alias("customers"))


@query("WITH s AS (SELECT s_nationkey AS nation, s_suppkey AS s, l_partkey AS p FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3), n AS (SELECT nation, s, count(*) AS n FROM s GROUP BY 1, 2), k AS (SELECT nation, count(*) AS k, sum(n) AS total FROM n GROUP BY 1), c AS (SELECT nation, count(*) AS c FROM (SELECT s.nation, p FROM s JOIN k ON k.nation = s.nation GROUP BY s.nation, p, k.k HAVING count(*) = k.k) GROUP BY 1), l AS (SELECT count(*)::DOUBLE AS l FROM part) SELECT k.nation, round(coalesce(c, 0) / l, 6) AS tightness, round(total / k / l, 6) AS coverage, round((SELECT avg(coalesce(c.c, 0)::DOUBLE / n.n) FROM n WHERE n.nation = k.nation), 6) AS overlap FROM k LEFT JOIN c ON c.nation = k.nation CROSS JOIN l")
def slice_metrics(spark, d):
    """Suppliers of a nation as slices of the list of parts."""
    li, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    x = li.join(s, li["l_suppkey"] == s["s_suppkey"]).select(F.col("s_nationkey").alias("group"), F.col("s_suppkey").alias("slice"), F.col("l_partkey").alias("element"))
    length = table(spark, d, "part").agg(F.count(F.lit(1)).alias("length"))
    m = metrics.slice_group_measures(x).join(F.broadcast(length))
    return m.select(F.col("group").alias("nation"), r6(F.col("common") / F.col("length")).alias("tightness"), r6(F.col("total") / F.col("slices") / F.col("length")).alias("coverage"), r6(F.col("overlap")).alias("overlap"))


# --- envy

_ENVY = """
a AS (SELECT DISTINCT c_custkey AS entity, c_nationkey AS source, s_nationkey AS owner, l_orderkey * 100000000 + l_partkey AS member FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
n AS (SELECT entity, source, owner, count(*) AS n FROM a GROUP BY 1, 2, 3),
x AS (SELECT n.*, coalesce(o.n, 0) AS sn FROM n LEFT JOIN n o ON o.entity = n.entity AND o.owner = n.source),
f AS (SELECT *, owner <> source AND n >= sn AS found FROM x),
s AS (SELECT *, (SELECT max(CASE WHEN g.found OR g.owner = g.source THEN 1 ELSE 0 END) FROM f g WHERE g.entity = f.entity AND g.n > f.n) AS stopped FROM f),
c AS (SELECT source, entity, owner AS target, sn::BIGINT AS source_deps, n::BIGINT AS target_deps FROM s WHERE coalesce(stopped, 0) = 0 AND found AND sn <= 2 AND sn < n)
"""


def _envy_accesses(spark, d):
    li, o, c, s = (table(spark, d, n) for n in ("lineitem", "orders", "customer", "supplier"))
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(s, li["l_suppkey"] == s["s_suppkey"]).select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").alias("source"), F.col("s_nationkey").alias("owner"), (F.col("l_orderkey") * 100000000 + F.col("l_partkey")).alias("member"))


@query(f"WITH {_ENVY} SELECT * FROM c")
def envy_candidates(spark, d):
    """Customers that buy from another nation more than from their own."""
    return candidates.move_methods(_envy_accesses(spark, d))


@query(f"WITH {_ENVY} SELECT *, row_number() OVER (ORDER BY source_deps, target_deps DESC, source, entity, target)::INTEGER AS rank FROM c")
def envy_ranked(spark, d):
    return candidates.ranked(candidates.move_methods(_envy_accesses(spark, d)))


@query("SELECT o_orderkey AS entity, s_nationkey AS owner, count(DISTINCT l_partkey)::BIGINT AS n, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) AS members FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2")
def access_map(spark, d):
    """Members that an order uses, by their owner."""
    li, s, o = table(spark, d, "lineitem"), table(spark, d, "supplier"), table(spark, d, "orders")
    x = li.join(s, li["l_suppkey"] == s["s_suppkey"]).join(o, li["l_orderkey"] == o["o_orderkey"], "left_semi")
    e = x.groupBy(F.col("l_orderkey").alias("entity")).agg(F.collect_set(F.concat(F.col("s_nationkey").cast("string"), F.lit("::"), F.col("l_partkey").cast("string"))).alias("eset"))
    out = facts.access_map(e)
    return out.select("entity", F.col("owner").cast("int").alias("owner"), F.size("members").cast("long").alias("n"), F.array_join(F.array_sort(F.transform("members", names.member_of)), ",").alias("members"))


@query("SELECT c_custkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi_delegate(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").select(F.col("c_custkey").alias("k"))


@query("SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_helper(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'")
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select(F.col("c_custkey").alias("k"))


# --- clones

@query("SELECT sha256(text) AS sha, count(*)::BIGINT AS n, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def clone_groups_exact(spark, d):
    docs = table(spark, d, "documents").filter("text IS NOT NULL")
    return clones.exact_groups(docs.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256)), "sha", "doc_id")


@query("SELECT sha256(text) AS group_id, CASE WHEN count(DISTINCT source || '/' || lang) = 1 THEN 'same method' WHEN count(DISTINCT source) = 1 THEN 'same file' ELSE 'different files' END AS location FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def clone_relative_location(spark, d):
    x = table(spark, d, "documents").filter("text IS NOT NULL").select(F.sha2(F.col("text").cast("binary"), 256).alias("group_id"), F.col("source").alias("file"), F.col("lang").alias("method"))
    groups = x.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return clones.relative_location(x.join(groups, "group_id", "left_semi"))


def _instances(spark, d):
    """Runs of a user's events of one type per day are instances: file the user, group the type and day, minutes the offsets."""
    e = table(spark, d, "events")
    minute = (F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000).cast("long")
    x = e.select(F.col("user_id").alias("file"), F.col("event_type"), F.to_date("ts").alias("day"), F.floor(minute).alias("m"))
    g = x.groupBy("file", "event_type", "day").agg(F.min("m").alias("start"), F.max("m").alias("end"))
    return g.select(F.concat_ws("/", F.col("event_type"), F.col("day").cast("string")).alias("group_id"), F.concat_ws("/", F.col("file").cast("string"), "event_type", F.col("day").cast("string")).alias("instance_id"), "file", "start", "end")


_INSTANCES = "i AS (SELECT event_type || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS group_id, CAST(user_id AS VARCHAR) || '/' || event_type || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS instance_id, user_id AS file, min(epoch_us(ts) // 60000000) AS s, max(epoch_us(ts) // 60000000) AS e FROM events GROUP BY event_type, CAST(ts AS DATE), user_id)"


@query(f"WITH {_INSTANCES} SELECT a.instance_id AS inner_id, b.instance_id AS outer_id FROM i a JOIN i b ON a.file = b.file AND b.s <= a.s AND a.e <= b.e AND a.group_id <> b.group_id")
def subclone_instances(spark, d):
    out = clones.sub_instances(_instances(spark, d), bin_width=1440)
    return out.select(F.col("i_instance_id").alias("inner_id"), F.col("o_instance_id").alias("outer_id"))


_HALVES = "h AS (SELECT user_id || '/' || event_type || '/' || CAST(CAST(ts AS DATE) AS VARCHAR) AS group_id, hour(ts) // 12 AS half, user_id AS file, min(epoch_us(ts) // 60000000) AS s, max(epoch_us(ts) // 60000000) AS e FROM events GROUP BY user_id, event_type, CAST(ts AS DATE), hour(ts) // 12), k AS (SELECT group_id, string_agg(file || ':' || s || ':' || e, ',' ORDER BY s) AS shape, count(*) AS n FROM h GROUP BY 1), i AS (SELECT h.* FROM h JOIN (SELECT min(group_id) AS group_id FROM k GROUP BY shape) u ON u.group_id = h.group_id), n AS (SELECT group_id, count(*) AS n FROM i GROUP BY 1)"


@query(f"WITH {_HALVES}, m AS (SELECT a.group_id, b.group_id AS parent, count(DISTINCT a.half) AS met FROM i a JOIN i b ON a.file = b.file AND b.s <= a.s AND a.e <= b.e AND a.group_id <> b.group_id GROUP BY 1, 2), g AS (SELECT m.group_id, m.parent FROM m JOIN n ON n.group_id = m.group_id WHERE met = n) SELECT group_id, parent, parent = min(parent) OVER (PARTITION BY group_id) AS first_parent FROM g")
def subclone_groups(spark, d):
    """A user's events of one type on a day form a group, a run for each half of the day; some lie inside another type's."""
    e = table(spark, d, "events")
    minute = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000).cast("long"))
    x = e.select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type", F.to_date("ts").cast("string")).alias("group_id"), F.floor(F.hour("ts") / 12).alias("instance_id"), F.col("user_id").alias("file"), minute.alias("m"))
    g = x.groupBy("group_id", "instance_id", "file").agg(F.min("m").alias("start"), F.max("m").alias("end"))
    return clones.sub_groups(g, bin_width=1440)


_TOKENS = "t AS (SELECT DISTINCT doc_id, lang, w FROM (SELECT doc_id, lang, unnest(regexp_split_to_array(text, '[ \\t-\\r]+')) AS w FROM documents) WHERE w <> ''), n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.lang = b.lang AND a.w = b.w AND a.doc_id < b.doc_id GROUP BY 1, 2)"


def _words(docs):
    """doc_id, lang, w: the words of documents, as arrays."""
    return docs.select("doc_id", "lang", F.array_remove(F.split("text", "[ \\t-\\r]+"), "").alias("w"))


@query(f"WITH {_TOKENS} SELECT a, b, c::BIGINT AS common, round(1 - c::DOUBLE / (x.n + y.n - c), 6) AS distance FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c::DOUBLE / (x.n + y.n - c) >= 0.8")
def near_clone_pairs(spark, d):
    """Documents of one language whose sets of words are at least 0.8 alike."""
    return clones.similar_arrays(_words(table(spark, d, "documents")), "doc_id", "w", 0.8, ["lang"]).select("a", "b", "common", r6("distance").alias("distance"))


@query(f"WITH {_TOKENS}, q AS (SELECT a, b, x.n AS na, y.n AS nb, c FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c::DOUBLE / (x.n + y.n - c) >= 0.8) SELECT q.a, q.b, CASE WHEN d.text = e.text THEN 'type 1' WHEN na = c AND nb = c THEN 'type 2' ELSE 'type 3' END AS type FROM q JOIN documents d ON d.doc_id = q.a JOIN documents e ON e.doc_id = q.b")
def clone_type(spark, d):
    """The type of near clones: the same text, the same words, or words missing."""
    docs = table(spark, d, "documents")
    text = docs.select("doc_id", "lang", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("mark"))
    x = clones.similar_arrays(_words(docs), "doc_id", "w", 0.8, ["lang"], text)
    return x.select("a", "b", clones.clone_type((F.col("distance") > 1e-9).cast("int"), (F.col("mark_a") != F.col("mark_b")).cast("int"), F.lit(0)).alias("type"))


@query("WITH l AS (SELECT doc_id, unnest(parts) AS value, unnest(range(len(parts))) AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)), o AS (SELECT *, coalesce(sum(length(value) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l) SELECT doc_id, (n + 1)::INTEGER AS line, s::BIGINT AS start, (s + length(value))::BIGINT AS \"end\" FROM o")
def line_offsets_of_documents(spark, d):
    return line_offsets(table(spark, d, "documents"), "doc_id").drop("value")


@query(f"WITH {_INSTANCES}, p AS (SELECT event_id, user_id, epoch_us(ts) // 60000000 AS m FROM events), j AS (SELECT event_id, instance_id, row_number() OVER (PARTITION BY event_id ORDER BY e - s, instance_id) AS rn FROM p JOIN i ON p.user_id = i.file AND s <= m AND m <= e) SELECT event_id, instance_id FROM j WHERE rn = 1")
def interval_innermost(spark, d):
    """The shortest run of events around each event of a user."""
    minute = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000).cast("long"))
    points = table(spark, d, "events").select("event_id", F.col("user_id").alias("file"), minute.alias("start"), minute.alias("end"))
    return joins.innermost(points, _instances(spark, d), ["file"], ["instance_id"], bin_width=1440).select(F.col("i_event_id").alias("event_id"), F.col("o_instance_id").alias("instance_id"))


# --- versions and text

_ASCII = "regexp_replace(text, '[^ -~]', '', 'g')"


@query(f"WITH x AS (SELECT conv_id, turn, {_ASCII} AS t, lag({_ASCII}) OVER (PARTITION BY conv_id ORDER BY turn, text) AS b FROM conversations WHERE text IS NOT NULL) SELECT conv_id, turn, levenshtein(b, t)::INTEGER AS distance FROM x WHERE b IS NOT NULL")
def turn_edit_distance(spark, d):
    x = table(spark, d, "conversations").filter("text IS NOT NULL").withColumn("t", F.regexp_replace("text", "[^ -~]", ""))
    y = evolution.between(x, ["conv_id"], ["turn", "text"], "t").filter("before IS NOT NULL")
    return y.select("conv_id", "turn", edits.char_distance(F.col("before"), F.col("t")).alias("distance"))


@query()
def token_edit_distance(spark, d):
    """Edit distance, similarity and change of the words of consecutive turns."""
    x = table(spark, d, "conversations").filter("text IS NOT NULL").withColumn("words", F.split("text", "[ \\t-\\r]+"))
    y = evolution.token_evolution(x, ["conv_id"], ["turn", "text"], "words")
    return y.select("conv_id", "turn", "distance", r6("similarity").alias("similarity"), r6("change").alias("change"))


@query("WITH m AS (SELECT c_nationkey AS nation, date_trunc('month', o_orderdate) AS month, count(*) AS n, count(DISTINCT o_custkey) AS c FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), l AS (SELECT *, lag(n) OVER w AS pn, lag(c) OVER w AS pc FROM m WINDOW w AS (PARTITION BY nation ORDER BY month)) SELECT nation, CAST(CAST(month AS DATE) AS VARCHAR) AS month, round(CASE WHEN greatest(n, pn) > 0 AND pn IS NOT NULL THEN abs(n - pn)::DOUBLE / greatest(n, pn) END, 6) AS size_change, round(CASE WHEN pn IS NOT NULL THEN 1 - abs(c - pc)::DOUBLE / greatest(n, pn) END, 6) AS envy FROM l")
def count_evolution(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    m = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_nationkey").alias("nation"), F.date_trunc("month", "o_orderdate").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("c"))
    w = W.partitionBy("nation").orderBy("month")
    x = m.withColumns({"pn": F.lag("n").over(w), "pc": F.lag("c").over(w)})
    some = F.col("pn").isNotNull()
    return x.select("nation", F.to_date("month").cast("string").alias("month"), r6(F.when(some, evolution.group_evolution(F.col("pn"), F.col("n")))).alias("size_change"), r6(F.when(some, evolution.envy_evolution(F.col("pc"), F.col("c"), F.col("pn"), F.col("n")))).alias("envy"))


_TERMS = "w AS (SELECT p_brand AS brand, lower(unnest(string_split(p_name, ' '))) AS word FROM part), n AS (SELECT brand, word, count(*) AS n FROM w GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY brand ORDER BY n DESC) AS r FROM n)"


@query(f"WITH {_TERMS} SELECT brand, string_agg(word, ',' ORDER BY word) AS terms, max(n)::BIGINT AS n FROM r WHERE r = 1 GROUP BY brand")
def topics_by_class(spark, d):
    w = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.explode(names.identifier_words(F.col("p_name"))).alias("word"))
    return metrics.modal(w, ["brand"], "word").select("brand", F.array_join("terms", ",").alias("terms"), "n")


@query()
def stemmed_topics(spark, d):
    """Modal stems of the names of a brand's parts; distinct words are stemmed once."""
    w = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.explode(names.identifier_words(F.col("p_name"))).alias("word"))
    s = w.select("word").distinct().withColumn("stem", F.get(edits.stems(F.array("word")), F.lit(0)))
    return metrics.modal(w.join(s, "word"), ["brand"], "stem").select("brand", F.array_join("terms", ",").alias("terms"), "n")


@query("SELECT p_partkey AS k, lower(array_to_string(regexp_extract_all(regexp_replace(p_name, ' ', '', 'g') || '_' || p_type, '[A-Z]+|[a-z]+'), ',')) AS words FROM part")
def camel_split(spark, d):
    x = F.concat(F.regexp_replace("p_name", " ", ""), F.lit("_"), F.col("p_type"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.array_join(names.identifier_words(x), ",").alias("words"))


# --- flow

def _line(spark, d):
    e = table(spark, d, "events")
    return flow.straight_dependences(e, "user_id", "ts", "event_id", F.col("event_type") == "view", F.col("event_type") == "purchase")


@query("SELECT user_id AS g, src, event_id AS dst FROM (SELECT user_id, event_id, event_type, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS src FROM events) WHERE event_type = 'purchase' AND src IS NOT NULL")
def reaching_defs(spark, d):
    return _line(spark, d)["data"]


@query("SELECT user_id AS g, event_id AS src, dst FROM (SELECT user_id, event_id, event_type, first_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS dst FROM events) WHERE event_type = 'purchase' AND dst IS NOT NULL")
def anti_dep(spark, d):
    return _line(spark, d)["anti"]


@query("SELECT user_id AS g, event_id AS src, dst FROM (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts) AS dst FROM events WHERE event_type = 'view') WHERE dst IS NOT NULL")
def output_dep(spark, d):
    return _line(spark, d)["output"]


@query("WITH s AS (SELECT user_id, ts, event_id, CASE WHEN row_number() OVER w = 1 OR event_type IN ('signup', 'error') THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) SELECT user_id, event_id, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)::BIGINT AS block FROM s")
def basic_blocks(spark, d):
    e = table(spark, d, "events").withColumn("leader", F.col("event_type").isin("signup", "error"))
    return graph.blocks(e, "user_id", "ts", "leader").select("user_id", "event_id", "block")


def _chain(spark, d):
    """A click depends on the last view before it, a purchase on the last click."""
    e = table(spark, d, "events")
    w = lambda t: joins.preceding(e, ["user_id"], ["ts"], F.col("event_type") == t, F.col("event_id"))
    x = e.withColumns({"view": w("view"), "click": w("click")})
    return x.filter("event_type = 'click' AND view IS NOT NULL").select(F.col("view").alias("src"), F.col("event_id").alias("dst")).unionByName(x.filter("event_type = 'purchase' AND click IS NOT NULL").select(F.col("click").alias("src"), F.col("event_id").alias("dst")))


_CHAIN = "x AS (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER w AS v, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), e AS (SELECT v AS src, event_id AS dst FROM x WHERE event_type = 'click' AND v IS NOT NULL UNION ALL SELECT c, event_id FROM x WHERE event_type = 'purchase' AND c IS NOT NULL)"


@query(f"WITH RECURSIVE {_CHAIN}, r AS (SELECT event_id AS criterion, event_id AS node FROM events WHERE event_type = 'purchase' UNION SELECT r.criterion, e.src FROM r JOIN e ON e.dst = r.node) SELECT criterion, node FROM r")
def backward_slice(spark, d):
    crit = table(spark, d, "events").filter("event_type = 'purchase'").select(F.col("event_id").alias("node"))
    return graph.backward_slice(_chain(spark, d), crit)


# --- graphs

def _hierarchy(spark, d):
    """region > nation > supplier and customer."""
    n, s, c = table(spark, d, "nation"), table(spark, d, "supplier"), table(spark, d, "customer")
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    return (
        n.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"))
        .unionByName(s.select(name("n", "s_nationkey").alias("src"), name("s", "s_suppkey").alias("dst")))
        .unionByName(c.select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst")))
    )


_HIER = "e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer), t AS (SELECT src, dst, 1 AS depth FROM e UNION ALL SELECT t.src, e.dst, t.depth + 1 FROM t JOIN e ON e.src = t.dst)"


@query(f"WITH RECURSIVE {_HIER} SELECT src, dst, min(depth)::INTEGER AS depth FROM t GROUP BY 1, 2")
def hierarchy_closure(spark, d):
    return graph.closure(_hierarchy(spark, d))


@query(f"WITH RECURSIVE {_HIER} SELECT dst AS leaf, min(depth)::INTEGER AS level FROM t WHERE src LIKE 'r%' AND dst NOT IN (SELECT src FROM e) GROUP BY 1")
def leaves_by_level(spark, d):
    roots = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return graph.leaves_by_level(_hierarchy(spark, d), roots)


def _partners(spark, d):
    """Pairs of nations that trade."""
    return _trade(spark, d).filter("src <> dst").select("src", "dst").distinct()


_PARTNERS = f"{_TRADE}, e AS (SELECT DISTINCT src, dst FROM trade WHERE src <> dst)"


def _net(spark, d):
    """Pairs of nations of which the first takes more from the second than it gives."""
    n = _trade(spark, d).filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    back = n.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("n").alias("m"))
    return n.join(back, ["src", "dst"], "left").filter("n > coalesce(m, 0)").select("src", "dst")


_NET = f"{_TRADE}, n AS (SELECT src, dst, count(*) AS n FROM trade WHERE src <> dst GROUP BY 1, 2), e AS (SELECT n.src, n.dst FROM n LEFT JOIN n m ON m.src = n.dst AND m.dst = n.src WHERE n.n > coalesce(m.n, 0))"


@query(f"WITH RECURSIVE {_PARTNERS}, t AS (SELECT [src, dst] AS path FROM e UNION ALL SELECT list_append(t.path, e.dst) FROM t JOIN e ON e.src = t.path[len(t.path)] WHERE len(t.path) < 4 AND NOT list_contains(t.path, e.dst)) SELECT array_to_string(path, '>') AS path, len(path)::INTEGER AS n FROM t")
def call_paths(spark, d):
    return graph.paths(_partners(spark, d), 4).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), F.size("path").alias("n"))


@query(f"WITH RECURSIVE {_NET}, t AS (SELECT src, dst, 1 AS depth FROM e UNION SELECT t.src, e.dst, t.depth + 1 FROM t JOIN e ON e.src = t.dst WHERE t.depth < 3), u AS (SELECT DISTINCT s_nationkey AS member, p_brand AS field FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey) SELECT member, field FROM u UNION SELECT t.src, u.field FROM t JOIN u ON u.member = t.dst")
def transitive_uses(spark, d):
    li, s, p = table(spark, d, "lineitem"), table(spark, d, "supplier"), table(spark, d, "part")
    u = li.join(s, li["l_suppkey"] == s["s_suppkey"]).join(p, li["l_partkey"] == p["p_partkey"]).select(F.col("s_nationkey").alias("member"), F.col("p_brand").alias("field")).distinct()
    return graph.transitive_uses(_net(spark, d), u, 3)


@query(f"WITH RECURSIVE {_NET}, t AS (SELECT src, dst FROM e UNION SELECT t.src, e.dst FROM t JOIN e ON e.src = t.dst) SELECT n_nationkey AS node, least(n_nationkey, coalesce((SELECT min(a.dst) FROM t a JOIN t b ON a.dst = b.src AND b.dst = a.src WHERE a.src = n_nationkey), n_nationkey)) AS component FROM nation")
def scc_groups(spark, d):
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").alias("node"))
    return graph.strong_components(_net(spark, d), nodes)


def _brand_links(spark, d):
    """The brands that a supplier deals in most."""
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    n = li.join(p, li["l_partkey"] == p["p_partkey"]).groupBy("l_suppkey", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    top = n.withColumn("top", F.max("n").over(W.partitionBy("l_suppkey"))).filter("n = top")
    return top.select(F.col("p_brand").alias("candidate"), F.col("l_suppkey").cast("string").alias("entity"))


@query("WITH RECURSIVE n AS (SELECT p_brand AS b, l_suppkey AS s, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), x AS (SELECT b, s FROM (SELECT *, max(n) OVER (PARTITION BY s) AS top FROM n) WHERE n = top), e AS (SELECT DISTINCT x.b AS a, y.b AS c FROM x JOIN x y ON x.s = y.s), t AS (SELECT a, c FROM e UNION SELECT t.a, e.c FROM t JOIN e ON e.a = t.c) SELECT a AS candidate, min(c) AS concept FROM t GROUP BY a")
def concept_components(spark, d):
    """Brands that some supplier deals in alike belong to one concept."""
    return cluster.concepts(_brand_links(spark, d))


@query("WITH x AS (SELECT l_orderkey AS k, l_suppkey AS e FROM lineitem GROUP BY 1, 2), n AS (SELECT k, count(*) AS n FROM x GROUP BY 1), c AS (SELECT a.k, b.k AS k2, count(*) AS c FROM x a JOIN x b ON a.e = b.e AND a.k <> b.k GROUP BY 1, 2) SELECT n.k, n.n::INTEGER AS n FROM n WHERE NOT EXISTS (SELECT 1 FROM c JOIN n m ON m.k = c.k2 WHERE c.k = n.k AND c.c = n.n AND (m.n > n.n OR (m.n = n.n AND c.k2 < n.k)))")
def subsumed_sets(spark, d):
    """Orders whose set of suppliers isn't part of another order's."""
    x = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_suppkey").alias("e"))
    return clones.without_subsumed(x, "k", "e").select("k", F.size("e").alias("n"))


@query()
def hier_clusters(spark, d):
    """Clusters of a nation's suppliers by the parts they sell."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("class"), F.lpad(F.col("s_suppkey").cast("string"), 10, "0").alias("entity"))
    li = _sells(spark, d).select(F.lpad(F.col("s").cast("string"), 10, "0").alias("entity"), "p")
    full = li.groupBy("entity").agg(F.collect_set("p").alias("full_set")).join(s, "entity")
    items = s.withColumn("position", F.row_number().over(W.partitionBy("class").orderBy("entity")))
    return cluster.hierarchical(items, candidates.pair_distances(full)).select("class", "cluster", F.array_join("entities", ",").alias("entities"))


# --- rankings and order

@query("SELECT nation, cust, orders, total FROM (SELECT c_nationkey AS nation, c_custkey AS cust, count(*)::BIGINT AS orders, round(sum(o_totalprice), 2) AS total, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, round(sum(o_totalprice), 2), c_custkey) AS rn FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) WHERE rn = 1")
def best_match(spark, d):
    """Each nation's customer with the most orders, then the least total."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    x = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("cust")).agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return clones.best_match(x, "nation", [F.desc("orders"), "total", "cust"])


@query("SELECT p_brand AS version, row_number() OVER (ORDER BY CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER))::INTEGER AS position FROM (SELECT DISTINCT p_brand FROM part)")
def natural_version_order(spark, d):
    x = table(spark, d, "part").select(F.col("p_brand").alias("version")).distinct()
    return x.withColumn("position", F.row_number().over(W.orderBy(names.version_key(F.col("version"))))).select("version", "position")


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN value + 1 ELSE value END AS value FROM events WHERE event_id % 5 <> 0 OR event_id % 7 = 0")
def incremental_upsert(spark, d):
    """A table of events after some are removed, some changed, and later ones added."""
    e = table(spark, d, "events").select("event_id", "value")
    middle = e.agg(((F.min("event_id") + F.max("event_id")) / 2).alias("m"))
    side = e.join(F.broadcast(middle))
    old, new = side.filter("event_id <= m").drop("m"), side.filter("event_id > m").drop("m")
    first = joins.upsert(old, ["event_id"], removed=old.filter("event_id % 5 = 0"), changed=old.filter("event_id % 7 = 0").withColumn("value", F.col("value") + 1))
    return joins.upsert(first, ["event_id"], added=new.filter("event_id % 5 <> 0 OR event_id % 7 = 0").withColumn("value", F.when(F.col("event_id") % 7 == 0, F.col("value") + 1).otherwise(F.col("value"))))


def queries() -> dict:
    from . import detector_queries, rule_queries, slice_queries, tree_queries  # noqa: F401  (they register their queries here)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
