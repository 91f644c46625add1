"""Joins of every shape, subqueries and CTEs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from .registry import Catalog, table

C = Catalog()

C.sql("join_inner", "SELECT o_orderkey, c_name, o_totalprice FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE c_acctbal > 0")
C.sql("join_left", "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 150000")
C.sql("join_right", "SELECT c_custkey, o_orderkey FROM {orders} RIGHT JOIN {customer} ON c_custkey = o_custkey AND o_orderstatus = 'P'")
C.sql("join_full", "SELECT c_nationkey, s_nationkey, c_custkey, s_suppkey FROM (SELECT * FROM {customer} WHERE c_acctbal < 1000) c FULL OUTER JOIN (SELECT * FROM {supplier} WHERE s_acctbal > 3000) s ON c_nationkey = s_nationkey")
C.sql("join_semi", "SELECT c_custkey, c_name FROM {customer} LEFT SEMI JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 250000",
      "SELECT c_custkey, c_name FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE c_custkey = o_custkey AND o_totalprice > 250000)")
C.sql("join_anti", "SELECT c_custkey, c_name FROM {customer} LEFT ANTI JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 400000",
      "SELECT c_custkey, c_name FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE c_custkey = o_custkey AND o_totalprice > 400000)")
C.sql("join_cross", "SELECT n_nationkey, r_regionkey FROM {nation} CROSS JOIN {region}")
C.sql("join_natural", "SELECT x, y, z FROM (SELECT n_nationkey AS x, n_regionkey AS y FROM {nation}) NATURAL JOIN (SELECT r_regionkey AS y, r_name AS z FROM {region})")
C.sql("join_residual", "SELECT c_custkey, o_orderkey FROM {customer} JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > c_acctbal * 30")
C.sql("join_theta", "SELECT s_suppkey, n_nationkey FROM {supplier} JOIN {nation} ON s_nationkey < n_nationkey AND s_acctbal > 100 * n_nationkey")
C.sql("join_self", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
C.sql("join_null_safe", "SELECT a.lang, a.n, b.n AS m FROM (SELECT nullif(lang, 'de') AS lang, count(*) AS n FROM {documents} GROUP BY 1) a JOIN (SELECT nullif(lang, 'fr') AS lang, count(DISTINCT source) AS n FROM {documents} GROUP BY 1) b ON a.lang <=> b.lang",
      "SELECT a.lang, a.n, b.n AS m FROM (SELECT nullif(lang, 'de') AS lang, count(*) AS n FROM {documents} GROUP BY 1) a JOIN (SELECT nullif(lang, 'fr') AS lang, count(DISTINCT source) AS n FROM {documents} GROUP BY 1) b ON a.lang IS NOT DISTINCT FROM b.lang")
C.sql("join_star", """SELECT r_name, p_brand, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {lineitem}
  JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {part} ON l_partkey = p_partkey
  JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY r_name, p_brand""")  # fmt: skip
C.sql("join_hints", "SELECT /*+ SHUFFLE_HASH(o) */ o_orderstatus, count(*) AS n FROM {lineitem} l JOIN {orders} o ON l_orderkey = o_orderkey GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) AS n FROM {lineitem} l JOIN {orders} o ON l_orderkey = o_orderkey GROUP BY o_orderstatus")
C.sql("join_merge_hint", "SELECT /*+ MERGE(o) */ l_linestatus, count(*) AS n FROM {lineitem} l JOIN {orders} o ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY l_linestatus", "SELECT l_linestatus, count(*) AS n FROM {lineitem} l JOIN {orders} o ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' GROUP BY l_linestatus")


@C.frame("join_using", "SELECT k, x, y FROM (SELECT n_regionkey AS k, n_nationkey AS x FROM nation WHERE n_regionkey < 3) FULL JOIN (SELECT r_regionkey AS k, r_name AS y FROM region WHERE r_regionkey > 1) USING (k)")
def _(spark, d):
    n = table(spark, d, "nation").where("n_regionkey < 3").selectExpr("n_regionkey AS k", "n_nationkey AS x")
    return n.join(table(spark, d, "region").where("r_regionkey > 1").selectExpr("r_regionkey AS k", "r_name AS y"), ["k"], "full")


@C.frame("join_checked_broadcast", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def _(spark, d):
    return J.join_small(table(spark, d, "customer"), table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@C.frame("join_salted", "SELECT l_returnflag, l_orderkey, l_linenumber, w FROM lineitem JOIN (SELECT l_returnflag AS f, count(*) AS w FROM lineitem GROUP BY 1) ON l_returnflag = f")
def _(spark, d):
    li = table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber")
    w = li.groupBy("l_returnflag").agg(F.count("*").alias("w"))
    return J.salted_join(li, w, "l_returnflag", salts=8)


_EV = "SELECT user_id, event_id, ts, value FROM events"


@C.frame("join_asof_backward", """SELECT p.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
  ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) v ON p.user_id = v.user_id AND p.ts >= v.ts""")  # fmt: skip
def _(spark, d):
    e = table(spark, d, "events")
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("view_id"))
    return J.asof_join(e.where("event_type = 'purchase'"), views, "user_id", "ts", ["view_id"]).select("event_id", "view_id")


@C.frame("join_asof_forward", """SELECT p.event_id, v.event_id AS next_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
  ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1, 2) v ON p.user_id = v.user_id AND p.ts <= v.ts""")  # fmt: skip
def _(spark, d):
    e = table(spark, d, "events")
    clicks = e.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("event_id").alias("next_id"))
    return J.asof_join(e.where("event_type = 'purchase'"), clicks, "user_id", "ts", ["next_id"], direction="forward").select("event_id", "next_id")


@C.frame("join_asof_cut", """SELECT p.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
  ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) v ON p.user_id = v.user_id AND p.ts >= v.ts""")  # fmt: skip
def _(spark, d):
    e = table(spark, d, "events")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return J.asof_join(e.where("event_type = 'purchase'"), views, "user_id", "ts", ["view_id"], cut="day").select("event_id", "view_id")


@C.frame("join_asof_forward_cut", """SELECT p.event_id, v.event_id AS next_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
  ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1, 2) v ON p.user_id = v.user_id AND p.ts <= v.ts""")  # fmt: skip
def _(spark, d):
    e = table(spark, d, "events")
    clicks = e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("next_id"))
    return J.asof_join(e.where("event_type = 'purchase'"), clicks, "user_id", "ts", ["next_id"], direction="forward", cut="week").select("event_id", "next_id")


@C.frame("join_range", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR WHERE a.event_type = 'purchase'")
def _(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    return J.range_join(e.where("event_type = 'purchase'"), e, "user_id", "ts", seconds=6 * 3600).selectExpr("l.event_id AS a", "r.event_id AS b")


C.sql("join_lateral_top_n", "SELECT c_custkey, o.o_orderkey, o.o_totalprice FROM {customer}, LATERAL (SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) o",
      "SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT c_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM {customer} JOIN {orders} ON o_custkey = c_custkey) WHERE r <= 2")
C.sql("join_lateral_column", "SELECT n_nationkey, t.d, t.s FROM {nation}, LATERAL (SELECT n_nationkey * 2 AS d, n_nationkey + n_regionkey AS s) t", "SELECT n_nationkey, n_nationkey * 2 AS d, n_nationkey + n_regionkey AS s FROM {nation}")

C.sql("subq_exists", "SELECT o_orderpriority, count(*) AS n FROM {orders} WHERE EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_quantity > 49) GROUP BY o_orderpriority")
C.sql("subq_not_exists", "SELECT s_suppkey FROM {supplier} WHERE NOT EXISTS (SELECT 1 FROM {lineitem} WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity > 49 AND l_linenumber = 3)")
C.sql("subq_in", "SELECT c_custkey FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 300000)")
C.sql("subq_not_in_nulls", "SELECT n_nationkey FROM {nation} WHERE n_nationkey NOT IN (SELECT CASE WHEN r_regionkey > 2 THEN NULL ELSE r_regionkey END FROM {region})")
C.sql("subq_not_in", "SELECT n_nationkey FROM {nation} WHERE n_nationkey NOT IN (SELECT c_nationkey FROM {customer} WHERE c_acctbal > 9300 AND c_mktsegment = 'BUILDING')")
C.sql("subq_scalar", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM {orders})")
C.sql("subq_scalar_correlated", "SELECT l_orderkey, l_linenumber FROM {lineitem} l WHERE l_quantity < (SELECT 0.2 * avg(l_quantity) FROM {lineitem} i WHERE i.l_partkey = l.l_partkey)")
C.sql("subq_scalar_select", "SELECT r_regionkey, (SELECT count(*) FROM {nation} WHERE n_regionkey = r_regionkey) AS n FROM {region}")
C.sql("subq_having", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_custkey HAVING sum(o_totalprice) > (SELECT 2.2 * avg(t) FROM (SELECT sum(o_totalprice) AS t FROM {orders} GROUP BY o_custkey))")
C.sql("subq_exists_or", "SELECT c_custkey FROM {customer} WHERE c_acctbal > 9500 OR EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 320000)")
C.sql("cte_reuse", "WITH t AS (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey) SELECT a.o_custkey, a.n FROM t a WHERE a.n = (SELECT max(n) FROM t)")
C.sql("cte_nested", "WITH a AS (WITH b AS (SELECT n_regionkey AS r FROM {nation}) SELECT r, count(*) AS n FROM b GROUP BY r) SELECT r_name, n FROM a JOIN {region} ON r = r_regionkey")
C.sql("cte_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 10) SELECT n, f FROM t")
C.sql("cte_recursive_graph", "WITH RECURSIVE t(k, depth) AS (SELECT 0, 0 UNION ALL SELECT n_nationkey, depth + 1 FROM t JOIN {nation} ON k = (n_nationkey - 1) DIV 2 WHERE n_nationkey > 0) SELECT k, depth FROM t",
      "WITH RECURSIVE t(k, depth) AS (SELECT 0, 0 UNION ALL SELECT n_nationkey, depth + 1 FROM t JOIN {nation} ON k = (n_nationkey - 1) // 2 WHERE n_nationkey > 0) SELECT k, depth FROM t")
