"""The rest of the function inventory, and further web-analytics and decision-support shapes."""

from __future__ import annotations

from .registry import Catalog

C = Catalog()

C.sql("fn_more_time", """SELECT n_nationkey, CAST(timestamp_millis(n_nationkey * 1000) AS STRING) AS ms, CAST(timestamp_micros(n_nationkey * 1000000) AS STRING) AS us, unix_seconds(timestamp_seconds(n_nationkey)) AS s, to_unix_timestamp('1970-01-01 00:00:07', 'yyyy-MM-dd HH:mm:ss') AS t,
  CAST(make_timestamp_ltz(2020, 1, 2, 3, 4, 5) AS STRING) AS ml, CAST(to_timestamp_ltz('2020-01-02') AS STRING) AS tl, CAST(datepart('DAY', DATE '2020-05-09') AS BIGINT) AS dp, curdate() = current_date() AS cd, current_timestamp() IS NOT NULL AS ct FROM {nation}""",
  """SELECT n_nationkey, strftime(to_timestamp(n_nationkey) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS ms, strftime(to_timestamp(n_nationkey) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS us, CAST(n_nationkey AS BIGINT) AS s, CAST(7 AS BIGINT) AS t,
  '2020-01-02 03:04:05' AS ml, '2020-01-02 00:00:00' AS tl, CAST(9 AS BIGINT) AS dp, true AS cd, true AS ct FROM nation""")  # fmt: skip
C.sql("fn_more_strings", "SELECT n_nationkey, CAST(character_length(n_name) AS BIGINT) AS cl, CAST(unbase64('YWJj') AS STRING) AS ub, regexp(n_name, '^N') AS rx, validate_utf8(n_name) AS v, try_validate_utf8(n_name) AS tv, make_valid_utf8(n_name) AS mv, CAST(ceiling(2.1) AS BIGINT) AS c FROM {nation}",
      "SELECT n_nationkey, length(n_name) AS cl, 'abc' AS ub, starts_with(n_name, 'N') AS rx, n_name AS v, n_name AS tv, n_name AS mv, CAST(3 AS BIGINT) AS c FROM nation")
C.sql("fn_more_aggregates", "SELECT n_regionkey, round(stddev(n_nationkey), 6) AS sd, round(variance(n_nationkey), 6) AS va, array_join(sort_array(array_agg(n_nationkey)), ',') AS ag, string_agg(n_name, ';') WITHIN GROUP (ORDER BY n_name) AS sa, round(mean(n_nationkey), 6) AS m FROM {nation} GROUP BY n_regionkey",
      "SELECT n_regionkey, round(stddev(n_nationkey), 6) AS sd, round(variance(n_nationkey), 6) AS va, array_to_string(list_sort(list(n_nationkey)), ',') AS ag, string_agg(n_name, ';' ORDER BY n_name) AS sa, round(avg(n_nationkey), 6) AS m FROM nation GROUP BY n_regionkey")
C.sql("fn_more_sketch", "SELECT abs(hll_sketch_estimate(hll_union(a, b)) - 25) <= 2 AS close FROM (SELECT hll_sketch_agg(n_nationkey) AS a FROM {nation} WHERE n_nationkey < 12), (SELECT hll_sketch_agg(n_nationkey) AS b FROM {nation} WHERE n_nationkey >= 10)", "SELECT true AS close")
C.sql("gen_outer_variants", "SELECT n_nationkey, pos, x, a FROM (SELECT n_nationkey, CASE WHEN n_nationkey = 1 THEN array(5, 6) END AS xs, CASE WHEN n_nationkey = 2 THEN array(struct(9 AS a)) END AS ss FROM {nation} WHERE n_nationkey < 4) LATERAL VIEW OUTER posexplode(xs) AS pos, x LATERAL VIEW OUTER inline(ss) AS a",
      "SELECT * FROM (VALUES (0, NULL, NULL, NULL), (1, 0, 5, NULL), (1, 1, 6, NULL), (2, NULL, NULL, 9), (3, NULL, NULL, NULL)) t(n_nationkey, pos, x, a)")
C.sql("gen_outer_table_functions", "SELECT r_regionkey, e.col AS e, p.pos, p.col AS p, i.a FROM {region}, LATERAL explode_outer(array(r_regionkey)) e, LATERAL posexplode_outer(array('q')) p, LATERAL inline_outer(array(struct(1 AS a))) i",
      "SELECT r_regionkey, r_regionkey AS e, 0 AS pos, 'q' AS p, 1 AS a FROM region")
C.sql("gen_variant_explode", "SELECT v.pos, v.key, CAST(v.value AS INT) AS val FROM variant_explode(parse_json('{\"a\":1,\"b\":2}')) v UNION ALL SELECT o.pos, o.key, CAST(o.value AS INT) FROM variant_explode_outer(parse_json('[]')) o",
      "SELECT * FROM (VALUES (0, 'a', 1), (1, 'b', 2), (NULL, NULL, NULL)) t(pos, key, val)")
C.sql("expr_checked_arithmetic", "SELECT n_nationkey, try_divide(n_nationkey, n_regionkey) AS d, n_nationkey / (n_regionkey + 1) AS q, CAST(n_nationkey AS BIGINT) * 1000000 AS m FROM {nation}",
      "SELECT n_nationkey, CASE WHEN n_regionkey <> 0 THEN n_nationkey / n_regionkey END AS d, n_nationkey / (n_regionkey + 1) AS q, CAST(n_nationkey AS BIGINT) * 1000000 AS m FROM nation")

for i, text in enumerate([
    "SELECT event_type, count(*) AS n FROM {events} WHERE event_type <> '' GROUP BY event_type ORDER BY n DESC, event_type LIMIT 10",
    "SELECT event_type, count(DISTINCT user_id) AS u FROM {events} WHERE value < 20 GROUP BY event_type ORDER BY u DESC, event_type LIMIT 10",
    "SELECT user_id, event_type, count(*) AS n FROM {events} WHERE value > 5 GROUP BY user_id, event_type ORDER BY n DESC, user_id, event_type LIMIT 10",
    "SELECT user_id, props, count(*) AS n FROM {events} GROUP BY user_id, props ORDER BY n DESC, user_id, props LIMIT 10",
    "SELECT event_type, min(props) AS p, min(user_id) AS u, count(*) AS n, count(DISTINCT user_id) AS d FROM {events} WHERE props LIKE '%3%' AND props NOT LIKE '%33%' GROUP BY event_type",
    "SELECT * FROM {events} WHERE props LIKE '%77%' ORDER BY ts, event_id LIMIT 10",
    "SELECT props, ts FROM {events} WHERE event_type = 'view' ORDER BY ts, props LIMIT 10",
    "SELECT props, event_id FROM {events} WHERE event_type = 'click' ORDER BY props, event_id LIMIT 10",
    "SELECT user_id, round(avg(length(props)), 4) AS l, count(*) AS n FROM {events} GROUP BY user_id HAVING count(*) > 5 ORDER BY l DESC, user_id LIMIT 25",
    "SELECT user_id, event_type, count(*) AS n, round(sum(value), 2) AS s, round(avg(value), 4) AS a FROM {events} WHERE value > 1 GROUP BY user_id, event_type ORDER BY n DESC, user_id, event_type LIMIT 10",
    "SELECT event_id, user_id, count(*) AS n, round(sum(value), 2) AS s FROM {events} GROUP BY event_id, user_id",
    "SELECT url, count(*) AS n FROM {pages} GROUP BY url ORDER BY n DESC, url LIMIT 10",
    "SELECT url, count(*) AS n FROM {pages} WHERE url LIKE 'https%' AND length(html) > 100 GROUP BY url ORDER BY n DESC, url LIMIT 10 OFFSET 5",
    "SELECT CASE WHEN value > 50 THEN event_type ELSE '' END AS src, user_id % 7 AS dst, count(*) AS n FROM {events} GROUP BY 1, 2",
    "SELECT user_id % 100 AS w, CAST(length(props) AS BIGINT) AS h, count(*) AS n FROM {events} WHERE value BETWEEN 10 AND 60 GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10 OFFSET 10",
    "SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS c FROM {documents} GROUP BY lang, source",
    "SELECT role, count(*) AS n, CAST(max(length(text)) AS BIGINT) AS longest FROM {conversations} GROUP BY role",
    "SELECT label, count(*) AS n FROM {embeddings} GROUP BY label",
], 26):
    C.sql(f"web_{i - 25:02d}", text)

_TOTALS = "SELECT c_nationkey AS nk, o_orderstatus AS st, CAST(year(o_orderdate) AS BIGINT) AS y, sum(o_totalprice) AS t FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY 1, 2, 3"
C.sql("ds_rank_within_year", f"SELECT * FROM (SELECT nk, y, round(sum(t), 2) AS t, CAST(rank() OVER (PARTITION BY y ORDER BY sum(t) DESC) AS BIGINT) AS r FROM ({_TOTALS}) GROUP BY nk, y) WHERE r <= 3")
C.sql("ds_above_average", f"WITH t AS ({_TOTALS}) SELECT a.nk, a.st, a.y FROM t a WHERE a.t > (SELECT avg(b.t) * 1.2 FROM t b WHERE b.nk = a.nk)")
C.sql("ds_deviation_from_mean", f"SELECT nk, y, t, m FROM (SELECT nk, y, round(t, 2) AS t, round(avg(t) OVER (PARTITION BY nk), 2) AS m FROM ({_TOTALS}) WHERE st = 'F') WHERE abs(t - m) > 0.5 * m")
C.sql("ds_neighbour_periods", f"SELECT nk, y, round(t, 2) AS t, round(lag(t) OVER (PARTITION BY nk ORDER BY y), 2) AS before, round(lead(t) OVER (PARTITION BY nk ORDER BY y), 2) AS after FROM ({_TOTALS}) WHERE st = 'O'")
C.sql("ds_quarter_columns", "SELECT c_mktsegment, " + ", ".join(f"round(sum(CASE WHEN quarter(o_orderdate) = {q} THEN o_totalprice ELSE 0 END), 2) AS q{q}" for q in range(1, 5)) + " FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY c_mktsegment")
C.sql("ds_day_buckets", "SELECT CASE WHEN d <= 30 THEN '30' WHEN d <= 60 THEN '60' WHEN d <= 90 THEN '90' ELSE 'more' END AS bucket, count(*) AS n FROM (SELECT abs(datediff(CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE))) AS d FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey) GROUP BY 1",
      "SELECT CASE WHEN d <= 30 THEN '30' WHEN d <= 60 THEN '60' WHEN d <= 90 THEN '90' ELSE 'more' END AS bucket, count(*) AS n FROM (SELECT abs(datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS d FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey) GROUP BY 1")
C.sql("ds_customers_in_both", "SELECT count(*) AS n FROM (SELECT o_custkey FROM {orders} WHERE year(o_orderdate) = 1996 GROUP BY o_custkey HAVING count(*) >= 2) a JOIN (SELECT o_custkey FROM {orders} WHERE year(o_orderdate) = 1997 GROUP BY o_custkey HAVING count(*) >= 2) b ON a.o_custkey = b.o_custkey")
C.sql("ds_cube_of_three", "SELECT o_orderstatus, o_orderpriority, c_mktsegment, count(*) AS n FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY CUBE (o_orderstatus, o_orderpriority, c_mktsegment)")
C.sql("ds_excess_discount", "SELECT round(sum(l_extendedprice * l_discount), 1) AS excess FROM {lineitem} l JOIN {part} ON l_partkey = p_partkey WHERE p_size < 10 AND l_discount > (SELECT 1.3 * avg(l_discount) FROM {lineitem} i WHERE i.l_partkey = l.l_partkey)")
C.sql("ds_top_union_bottom", "SELECT * FROM (SELECT 'top' AS kind, c_custkey FROM {customer} ORDER BY c_acctbal DESC, c_custkey LIMIT 5) UNION ALL SELECT * FROM (SELECT 'bottom' AS kind, c_custkey FROM {customer} ORDER BY c_acctbal, c_custkey LIMIT 5)")
