"""The TPC-H, TPC-DS and web-analytics query shapes over the fixture's tables.

Tables or columns the fixture lacks are replaced: partsupp is derived from lineitem, commit and
receipt dates by ship and order dates.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.aggregates import prefix_sums
from .registry import Catalog, table

C = Catalog()
_REV = "l_extendedprice * (1 - l_discount)"
_PS = "{partsupp}"

C.sql("tpch_q01", f"""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum({_REV}), 2) AS sum_disc_price,
  round(sum({_REV} * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
  FROM {{lineitem}} WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""")  # fmt: skip
C.sql("tpch_q02", f"""SELECT s_acctbal, s_name, n_name, p_partkey FROM {{part}}, {{supplier}}, {_PS} ps, {{nation}}, {{region}} WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size < 15 AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_regionkey = 1
  AND ps_supplycost = (SELECT min(i.ps_supplycost) FROM {_PS} i, {{supplier}} s2, {{nation}} n2 WHERE p_partkey = i.ps_partkey AND s2.s_suppkey = i.ps_suppkey AND s2.s_nationkey = n2.n_nationkey AND n2.n_regionkey = 1)""")  # fmt: skip
C.sql("tpch_q03", f"SELECT l_orderkey, round(sum({_REV}), 2) AS revenue, o_orderdate FROM {{customer}}, {{orders}}, {{lineitem}} WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < DATE '1995-03-15' AND l_shipdate > DATE '1995-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10")
C.sql("tpch_q04", "SELECT o_orderpriority, count(*) AS order_count FROM {orders} WHERE o_orderdate >= DATE '1997-07-01' AND o_orderdate < DATE '1997-10-01' AND EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority")
C.sql("tpch_q05", f"SELECT n_name, round(sum({_REV}), 2) AS revenue FROM {{customer}}, {{orders}}, {{lineitem}}, {{supplier}}, {{nation}}, {{region}} WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_regionkey < 3 GROUP BY n_name")
C.sql("tpch_q06", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM {lineitem} WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
C.sql("tpch_q07", f"""SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS BIGINT) AS l_year, round(sum({_REV}), 0) AS revenue FROM {{supplier}}, {{lineitem}}, {{orders}}, {{customer}}, {{nation}} n1, {{nation}} n2
  WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey AND ((n1.n_nationkey < 5 AND n2.n_nationkey >= 20) OR (n1.n_nationkey >= 20 AND n2.n_nationkey < 5)) GROUP BY 1, 2, 3""")  # fmt: skip
C.sql("tpch_q08", f"""SELECT o_year, round(sum(CASE WHEN nation = 'NATION_2' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (SELECT CAST(year(o_orderdate) AS BIGINT) AS o_year, {_REV} AS volume, n2.n_name AS nation FROM {{part}}, {{supplier}}, {{lineitem}}, {{orders}}, {{customer}}, {{nation}} n1, {{nation}} n2, {{region}}
  WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey AND s_nationkey = n2.n_nationkey AND p_size > 25) GROUP BY o_year""")  # fmt: skip
C.sql("tpch_q09", f"SELECT n_name AS nation, CAST(year(o_orderdate) AS BIGINT) AS o_year, round(sum({_REV} - ps_supplycost * l_quantity), 0) AS profit FROM {{part}}, {{supplier}}, {{lineitem}}, {_PS} ps, {{orders}}, {{nation}} WHERE s_suppkey = l_suppkey AND ps_suppkey = l_suppkey AND ps_partkey = l_partkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%red%' GROUP BY 1, 2")
C.sql("tpch_q10", f"SELECT c_custkey, c_name, round(sum({_REV}), 2) AS revenue, c_acctbal, n_name FROM {{customer}}, {{orders}}, {{lineitem}}, {{nation}} WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1997-10-01' AND o_orderdate < DATE '1998-01-01' AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20")
C.sql("tpch_q11", f"SELECT ps_partkey, round(sum(ps_supplycost * ps_availqty), 1) AS val FROM {_PS} ps, {{supplier}}, {{nation}} WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = 2 GROUP BY ps_partkey HAVING sum(ps_supplycost * ps_availqty) > (SELECT sum(ps_supplycost * ps_availqty) * 0.001 FROM {_PS} p2, {{supplier}}, {{nation}} WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = 2)")
C.sql("tpch_q12", "SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low FROM {orders}, {lineitem} WHERE o_orderkey = l_orderkey AND l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' GROUP BY l_linestatus")
C.sql("tpch_q13", "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%LOW%' GROUP BY c_custkey) GROUP BY c_count")
C.sql("tpch_q14", f"SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {_REV} ELSE 0 END) / sum({_REV}), 4) AS promo FROM {{lineitem}}, {{part}} WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1995-09-01' AND l_shipdate < DATE '1995-12-01'")
C.sql("tpch_q15", f"WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum({_REV}), 2) AS total FROM {{lineitem}} WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01' GROUP BY l_suppkey) SELECT s_suppkey, s_name, total FROM {{supplier}}, revenue WHERE s_suppkey = supplier_no AND total = (SELECT max(total) FROM revenue)")
C.sql("tpch_q16", f"SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM {_PS} ps, {{part}} WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#45' AND p_size IN (1, 4, 9, 14, 19, 23, 36, 45, 49) AND ps_suppkey NOT IN (SELECT s_suppkey FROM {{supplier}} WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size")
C.sql("tpch_q17", "SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM {lineitem}, {part} WHERE p_partkey = l_partkey AND p_size < 20 AND l_quantity < (SELECT 0.2 * avg(l_quantity) FROM {lineitem} WHERE l_partkey = p_partkey)")
C.sql("tpch_q18", "SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS q FROM {customer}, {orders}, {lineitem} WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey HAVING sum(l_quantity) > 200) AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
C.sql("tpch_q19", f"SELECT round(sum({_REV}), 2) AS revenue FROM {{lineitem}}, {{part}} WHERE p_partkey = l_partkey AND ((p_size BETWEEN 1 AND 5 AND l_quantity BETWEEN 1 AND 11) OR (p_size BETWEEN 1 AND 10 AND l_quantity BETWEEN 10 AND 20) OR (p_size BETWEEN 1 AND 15 AND l_quantity BETWEEN 20 AND 30))")
C.sql("tpch_q20", f"SELECT s_name FROM {{supplier}}, {{nation}} WHERE s_suppkey IN (SELECT ps_suppkey FROM {_PS} ps WHERE ps_partkey IN (SELECT p_partkey FROM {{part}} WHERE p_name LIKE '%ring%') AND ps_availqty > (SELECT 0.5 * sum(l_quantity) FROM {{lineitem}} WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= DATE '1998-01-01')) AND s_nationkey = n_nationkey AND n_regionkey = 3")
C.sql("tpch_q21", "SELECT s_name, count(*) AS numwait FROM {supplier}, {lineitem} l1, {orders} WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_returnflag = 'R' AND EXISTS (SELECT 1 FROM {lineitem} l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey) AND NOT EXISTS (SELECT 1 FROM {lineitem} l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R') GROUP BY s_name")
C.sql("tpch_q22", "SELECT cntry, count(*) AS numcust, round(sum(c_acctbal), 2) AS total FROM (SELECT substring(CAST(c_nationkey + 10 AS STRING) FROM 1 FOR 2) AS cntry, c_acctbal FROM {customer} WHERE c_nationkey IN (1, 3, 5, 7, 9) AND c_acctbal > (SELECT avg(c_acctbal) FROM {customer} WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 200000)) GROUP BY cntry")

# web analytics over events and pages: the 43 shapes of the public benchmark, with its numbers. props stands for the search
# phrase, user_id % 20 for the region, event_type for engine and phone; ties are broken so that limits are definite
_JAN = "ts >= TIMESTAMP_NTZ '2024-01-05 00:00:00' AND ts < TIMESTAMP_NTZ '2024-01-20 00:00:00'"
for i, text in enumerate([
    "SELECT count(*) AS n FROM {events}",
    "SELECT count(*) AS n FROM {events} WHERE event_type <> 'view'",
    "SELECT round(sum(value), 2) AS s, count(*) AS n, round(avg(user_id), 6) AS a FROM {events}",
    "SELECT round(avg(user_id), 6) AS a FROM {events}",
    "SELECT count(DISTINCT user_id) AS u FROM {events}",
    "SELECT count(DISTINCT props) AS p FROM {events}",
    "SELECT min(ts) AS lo, max(ts) AS hi FROM {events}",
    "SELECT event_type, count(*) AS n FROM {events} WHERE event_type <> 'view' GROUP BY event_type ORDER BY n DESC",
    "SELECT user_id % 20 AS region, count(DISTINCT user_id) AS u FROM {events} GROUP BY 1 ORDER BY u DESC, region LIMIT 10",
    "SELECT user_id % 20 AS region, round(sum(value), 2) AS s, count(*) AS n, round(avg(value), 6) AS a, count(DISTINCT user_id) AS u FROM {events} GROUP BY 1 ORDER BY n DESC, region LIMIT 10",
    "SELECT event_type, count(DISTINCT user_id) AS u FROM {events} WHERE event_type <> 'error' GROUP BY event_type ORDER BY u DESC, event_type LIMIT 10",
    "SELECT user_id % 3 AS phone, event_type, count(DISTINCT user_id) AS u FROM {events} WHERE event_type <> 'error' GROUP BY 1, 2 ORDER BY u DESC, 1, 2 LIMIT 10",
    "SELECT props, count(*) AS n FROM {events} WHERE props <> '' GROUP BY props ORDER BY n DESC, props LIMIT 10",
    "SELECT props, count(DISTINCT user_id) AS u FROM {events} WHERE props <> '' GROUP BY props ORDER BY u DESC, props LIMIT 10",
    "SELECT event_type, props, count(*) AS n FROM {events} WHERE props <> '' GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10",
    "SELECT user_id, count(*) AS n FROM {events} GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10",
    "SELECT user_id, props, count(*) AS n FROM {events} GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10",
    "SELECT user_id, props, count(*) AS n FROM {events} GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 10",
    "SELECT user_id, CAST(minute(ts) AS BIGINT) AS m, props, count(*) AS n FROM {events} GROUP BY 1, 2, 3 ORDER BY n DESC, 1, 2, 3 LIMIT 10",
    "SELECT user_id, event_id FROM {events} WHERE user_id = 7",
    "SELECT count(*) AS n FROM {events} WHERE props LIKE '%77%'",
    "SELECT event_type, min(props) AS p, count(*) AS n FROM {events} WHERE props LIKE '%7%' AND event_type <> '' GROUP BY event_type ORDER BY n DESC, 1 LIMIT 10",
    "SELECT event_type, min(props) AS p, max(ts) AS t, count(*) AS n, count(DISTINCT user_id) AS u FROM {events} WHERE props LIKE '%1%' AND props NOT LIKE '%11%' AND event_type <> '' GROUP BY event_type ORDER BY n DESC, 1 LIMIT 10",
    "SELECT * FROM {events} WHERE props LIKE '%9%' ORDER BY ts, event_id LIMIT 10",
    "SELECT props, event_id FROM {events} WHERE props <> '' ORDER BY ts, event_id LIMIT 10",
    "SELECT props FROM {events} WHERE props <> '' ORDER BY props LIMIT 10",
    "SELECT props FROM {events} WHERE props <> '' ORDER BY ts, props LIMIT 10",
    "SELECT user_id % 20 AS counter, round(avg(length(props)), 4) AS l, count(*) AS n FROM {events} WHERE props <> '' GROUP BY 1 HAVING count(*) > 10 ORDER BY l DESC, counter LIMIT 25",
    ("SELECT regexp_replace(url, '^https?://(?:www\\\\.)?([^/?#]+).*$', '$1') AS host, round(avg(length(url)), 4) AS l, count(*) AS n, min(url) AS u FROM {pages} WHERE url <> '' GROUP BY 1 HAVING count(*) > 1 ORDER BY l DESC, host LIMIT 25",
     "SELECT regexp_replace(url, '^https?://(?:www\\.)?([^/?#]+).*$', '\\1') AS host, round(avg(length(url)), 4) AS l, count(*) AS n, min(url) AS u FROM {pages} WHERE url <> '' GROUP BY 1 HAVING count(*) > 1 ORDER BY l DESC, host LIMIT 25"),
    "SELECT " + ", ".join(f"CAST(sum(user_id + {k}) AS BIGINT) AS s{k:02}" for k in range(90)) + " FROM {events}",
    "SELECT event_type, user_id, count(*) AS n, round(sum(value), 2) AS s, round(avg(value), 6) AS a FROM {events} WHERE props <> '' GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10",
    "SELECT event_id, user_id, count(*) AS n, round(sum(value), 2) AS s FROM {events} WHERE props <> '' GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10",
    "SELECT event_id, user_id, count(*) AS n, round(sum(value), 2) AS s FROM {events} GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10",
    "SELECT url, count(*) AS n FROM {pages} GROUP BY url ORDER BY n DESC, url LIMIT 10",
    "SELECT 1 AS one, url, count(*) AS n FROM {pages} GROUP BY 1, 2 ORDER BY n DESC, url LIMIT 10",
    "SELECT user_id, user_id - 1 AS a, user_id - 2 AS b, user_id - 3 AS c, count(*) AS n FROM {events} GROUP BY 1, 2, 3, 4 ORDER BY n DESC, user_id LIMIT 10",
    f"SELECT props, count(*) AS views FROM {{events}} WHERE user_id % 20 = 3 AND {_JAN} AND event_type = 'view' AND props <> '' GROUP BY props ORDER BY views DESC, props LIMIT 10",
    f"SELECT user_id, count(*) AS views FROM {{events}} WHERE user_id % 20 = 3 AND {_JAN} AND event_type = 'view' AND props <> '' GROUP BY user_id ORDER BY views DESC, user_id LIMIT 10",
    f"SELECT props, count(*) AS views FROM {{events}} WHERE {_JAN} AND event_type IN ('view', 'click') AND value > 5 GROUP BY props ORDER BY views DESC, props LIMIT 10 OFFSET 20",
    f"SELECT user_id % 3 AS source, event_type, CASE WHEN event_type = 'click' AND user_id % 3 = 0 THEN props ELSE '' END AS src, count(*) AS views FROM {{events}} WHERE user_id % 20 = 3 AND {_JAN} GROUP BY 1, 2, 3 ORDER BY views DESC, 1, 2, 3 LIMIT 10",
    f"SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS views FROM {{events}} WHERE {_JAN} AND user_id % 3 IN (0, 2) AND event_type = 'click' GROUP BY 1, 2 ORDER BY views DESC, 1, 2 LIMIT 10 OFFSET 5",
    f"SELECT user_id % 5 AS w, user_id % 7 AS h, count(*) AS views FROM {{events}} WHERE {_JAN} AND event_type = 'purchase' GROUP BY 1, 2 ORDER BY views DESC, 1, 2 LIMIT 10 OFFSET 3",
    ("SELECT CAST(date_trunc('minute', ts) AS TIMESTAMP_NTZ) AS m, count(*) AS views FROM {events} WHERE " + _JAN + " AND event_type <> 'error' GROUP BY 1 ORDER BY 1 LIMIT 10 OFFSET 5",
     "SELECT date_trunc('minute', ts) AS m, count(*) AS views FROM {events} WHERE " + _JAN + " AND event_type <> 'error' GROUP BY 1 ORDER BY 1 LIMIT 10 OFFSET 5"),
], 1):
    own, duck = text if isinstance(text, tuple) else (text, text)
    C.sql(f"click_q{i:02d}", own, duck.replace("TIMESTAMP_NTZ '", "TIMESTAMP '"))

C.sql("ds_rollup_rank", "SELECT st, pr, total, lv, rk FROM (SELECT o_orderstatus AS st, o_orderpriority AS pr, round(sum(o_totalprice), 2) AS total, CAST(grouping(o_orderstatus) + grouping(o_orderpriority) AS BIGINT) AS lv, CAST(rank() OVER (PARTITION BY grouping(o_orderstatus) + grouping(o_orderpriority), CASE WHEN grouping(o_orderpriority) = 0 THEN o_orderstatus END ORDER BY sum(o_totalprice) DESC) AS BIGINT) AS rk FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority))")
C.sql("ds_intersect_channels", "SELECT count(*) AS n FROM (SELECT DISTINCT o_custkey FROM {orders} WHERE o_orderstatus = 'F' INTERSECT SELECT DISTINCT o_custkey FROM {orders} WHERE o_orderstatus = 'O' INTERSECT SELECT DISTINCT o_custkey FROM {orders} WHERE o_orderpriority = '5-LOW')")
C.sql("ds_except_channels", "SELECT count(*) AS n FROM (SELECT DISTINCT o_custkey FROM {orders} WHERE o_orderstatus = 'F' EXCEPT SELECT DISTINCT o_custkey FROM {orders} WHERE o_orderstatus = 'P')")
@C.frame("ds_full_outer_cumulative", "WITH a AS (SELECT CAST(o_orderdate AS DATE) AS d, sum(sum(o_totalprice)) OVER (ORDER BY CAST(o_orderdate AS DATE) ROWS UNBOUNDED PRECEDING) AS c FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT CAST(o_orderdate AS DATE) AS d, sum(sum(o_totalprice)) OVER (ORDER BY CAST(o_orderdate AS DATE) ROWS UNBOUNDED PRECEDING) AS c FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) SELECT coalesce(a.d, b.d) AS d, round(a.c, -1) AS ac, round(b.c, -1) AS bc FROM a FULL OUTER JOIN b ON a.d = b.d")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", F.to_date("o_orderdate").alias("d"), "o_totalprice")

    def running(status: str, name: str):
        days = o.where(F.col("o_orderstatus") == status).groupBy("d").agg(F.sum("o_totalprice").alias("t"))
        return prefix_sums(days, "d", "t", name, F.date_trunc("month", "d")).select("d", F.round(name, -1).alias(name))

    return running("F", "ac").join(running("O", "bc"), "d", "full")


C.sql("ds_year_over_year", "WITH y AS (SELECT o_custkey AS c, CAST(year(o_orderdate) AS BIGINT) AS y, sum(o_totalprice) AS t FROM {orders} GROUP BY 1, 2) SELECT a.c, a.y, round(b.t / a.t, 6) AS growth FROM y a JOIN y b ON a.c = b.c AND b.y = a.y + 1 WHERE b.t > a.t")
C.sql("ds_union_channels", "SELECT channel, k, CAST(sum(n) AS BIGINT) AS n FROM (SELECT 'orders' AS channel, o_custkey % 10 AS k, count(*) AS n FROM {orders} GROUP BY 1, 2 UNION ALL SELECT 'lines', l_suppkey % 10, count(*) FROM {lineitem} GROUP BY 1, 2 UNION ALL SELECT 'events', user_id % 10, count(*) FROM {events} GROUP BY 1, 2) GROUP BY ROLLUP (channel, k)")
C.sql("ds_ratio_to_report", "SELECT p_brand, p_type, round(sum(l_extendedprice), 2) AS rev, round(sum(l_extendedprice) * 100 / sum(sum(l_extendedprice)) OVER (PARTITION BY p_brand), 6) AS ratio FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY p_brand, p_type")
C.sql("ds_case_buckets", "SELECT CASE WHEN (SELECT count(*) FROM {lineitem} WHERE l_quantity BETWEEN 1 AND 20) > 100 THEN (SELECT round(avg(l_discount), 6) FROM {lineitem} WHERE l_quantity BETWEEN 1 AND 20) ELSE (SELECT round(avg(l_tax), 6) FROM {lineitem}) END AS bucket1")
