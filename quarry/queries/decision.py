"""Decision-support shapes: channels, periods, ratios, buckets and ranks over the fixture's tables.

The three channels of a retailer are the lines with return flag N, A and R; a line's promotion is a
discount of 0.05 or more; its week is counted from the first of January 1995.
"""

from __future__ import annotations

from .registry import Catalog

C = Catalog()
_SALES = "SELECT l.*, o_custkey, o_orderdate, o_orderstatus, o_orderpriority, l_extendedprice * (1 - l_discount) AS rev, l_extendedprice * l_discount AS cut, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(quarter(o_orderdate) AS BIGINT) AS q FROM {lineitem} l JOIN {orders} ON l_orderkey = o_orderkey"
_DAYS = "datediff(l_shipdate, o_orderdate)"
_WEEK = "CAST(floor(datediff(o_orderdate, DATE '1995-01-01') / 7) AS BIGINT)"


def _add(name: str, text: str) -> None:
    """DuckDB names the unit of a difference of days first, the earlier day before the later one, and counts weekdays from 0."""
    duck = text.replace(_DAYS, "datediff('day', o_orderdate, l_shipdate)").replace("datediff(o_orderdate, DATE '1995-01-01')", "datediff('day', DATE '1995-01-01', o_orderdate)")
    C.sql(f"ds_{name}", text, duck.replace("dayofweek(o_orderdate)", "(dayofweek(o_orderdate) + 1)"))


def _channel(flag: str, cols: str, group: str) -> str:
    return f"SELECT {cols} FROM ({_SALES}) WHERE l_returnflag = '{flag}' GROUP BY {group}"


_add("customers_above_nation_mean", f"WITH t AS (SELECT o_custkey AS c, sum(rev) AS r FROM ({_SALES}) WHERE l_returnflag = 'R' GROUP BY 1), n AS (SELECT c, r, c_nationkey AS k FROM t JOIN {{customer}} ON c = c_custkey) SELECT c, round(r, 2) AS r FROM n a WHERE r > (SELECT avg(r) * 1.6 FROM n b WHERE b.k = a.k)")
_add("week_on_week_ratio", f"WITH w AS (SELECT {_WEEK} AS wk, sum(CASE WHEN dayofweek(o_orderdate) = 1 THEN o_totalprice ELSE 0 END) AS a, sum(CASE WHEN dayofweek(o_orderdate) <> 1 THEN o_totalprice ELSE 0 END) AS b FROM {{orders}} GROUP BY 1) SELECT x.wk, round((z.a + z.b) / (x.a + x.b), 6) AS ratio FROM w x JOIN w z ON z.wk = x.wk + 52")
_add("brand_revenue_by_year", f"SELECT y, p_brand, round(sum(rev), 2) AS r FROM ({_SALES}) JOIN {{part}} ON l_partkey = p_partkey WHERE m = 11 GROUP BY y, p_brand")
_add("growth_faster_in_one_channel", f"WITH t AS (SELECT o_custkey AS c, l_returnflag AS ch, y, sum(rev) AS r FROM ({_SALES}) WHERE y IN (1996, 1997) GROUP BY 1, 2, 3) SELECT a.c FROM t a JOIN t b ON a.c = b.c AND a.ch = 'N' AND b.ch = 'N' AND a.y = 1996 AND b.y = 1997 JOIN t d ON a.c = d.c AND d.ch = 'R' AND d.y = 1996 JOIN t e ON a.c = e.c AND e.ch = 'R' AND e.y = 1997 WHERE b.r / a.r > e.r / d.r")
_add("channel_rollup", f"SELECT ch, k, round(sum(r), 2) AS r, CAST(sum(n) AS BIGINT) AS n FROM ({_channel('N', "'store' AS ch, l_suppkey % 7 AS k, sum(rev) AS r, count(*) AS n", '1, 2')} UNION ALL {_channel('A', "'catalog', l_suppkey % 7, sum(rev), count(*)", '1, 2')} UNION ALL {_channel('R', "'web', l_suppkey % 7, -sum(rev), count(*)", '1, 2')}) GROUP BY ROLLUP (ch, k)")
_add("nations_with_dear_parts", "SELECT n_name, count(*) AS n FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {orders} ON o_custkey = c_custkey JOIN {lineitem} ON l_orderkey = o_orderkey JOIN {part} p ON l_partkey = p_partkey WHERE p_retailprice > (SELECT 1.002 * avg(i.p_retailprice) FROM {part} i WHERE i.p_type = p.p_type) GROUP BY n_name HAVING count(*) >= 3")
_add("averages_under_or_conditions", f"SELECT p_type, round(avg(l_quantity), 6) AS q, round(avg(l_extendedprice), 4) AS p, round(avg(l_discount), 6) AS d FROM ({_SALES}) JOIN {{part}} ON l_partkey = p_partkey WHERE (o_orderpriority = '1-URGENT' OR l_discount >= 0.05 AND o_orderstatus = 'F') AND y = 1998 GROUP BY p_type")
_add("name_prefix_join", "SELECT s_name, count(*) AS n FROM {supplier} JOIN {customer} ON substring(s_name, 18, 2) = substring(c_name, 18, 2) WHERE c_mktsegment = 'BUILDING' GROUP BY s_name")
_add("customers_in_all_channels", f"SELECT c_mktsegment, count(*) AS n FROM {{customer}} c WHERE EXISTS (SELECT 1 FROM ({_SALES}) WHERE o_custkey = c.c_custkey AND l_returnflag = 'N') AND EXISTS (SELECT 1 FROM ({_SALES}) WHERE o_custkey = c.c_custkey AND l_returnflag = 'A') AND EXISTS (SELECT 1 FROM ({_SALES}) WHERE o_custkey = c.c_custkey AND l_returnflag = 'R') GROUP BY c_mktsegment")
_add("three_or_bands", f"SELECT round(avg(l_quantity), 6) AS q, round(avg(rev), 4) AS r, count(*) AS n FROM ({_SALES}) JOIN {{customer}} ON o_custkey = c_custkey WHERE (c_mktsegment = 'BUILDING' AND l_quantity BETWEEN 1 AND 10 AND c_nationkey IN (1, 2, 3)) OR (c_mktsegment = 'MACHINERY' AND l_quantity BETWEEN 11 AND 20 AND c_nationkey IN (4, 5, 6)) OR (c_mktsegment = 'HOUSEHOLD' AND l_quantity BETWEEN 21 AND 30 AND c_nationkey IN (7, 8, 9))")
_add("shipped_by_two_not_returned", f"SELECT count(DISTINCT l_orderkey) AS orders, round(sum(rev), 2) AS r FROM ({_SALES}) s WHERE EXISTS (SELECT 1 FROM {{lineitem}} x WHERE x.l_orderkey = s.l_orderkey AND x.l_suppkey <> s.l_suppkey) AND NOT EXISTS (SELECT 1 FROM {{lineitem}} z WHERE z.l_orderkey = s.l_orderkey AND z.l_returnflag = 'R')")
_add("quantity_statistics", f"SELECT l_returnflag, q, count(l_quantity) AS n, round(avg(l_quantity), 6) AS a, round(stddev_samp(l_quantity), 6) AS s, round(stddev_samp(l_quantity) / avg(l_quantity), 6) AS cov FROM ({_SALES}) WHERE y = 1997 GROUP BY l_returnflag, q")
_add("four_level_rollup", f"SELECT r_name, n_name, c_mktsegment, round(avg(l_quantity), 6) AS q FROM ({_SALES}) JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey WHERE y = 1996 GROUP BY ROLLUP (r_name, n_name, c_mktsegment)")
_add("before_and_after_a_day", f"SELECT l_suppkey, CAST(sum(CASE WHEN o_orderdate < DATE '1998-03-11' THEN l_quantity ELSE 0 END) AS BIGINT) AS before, CAST(sum(CASE WHEN o_orderdate >= DATE '1998-03-11' THEN l_quantity ELSE 0 END) AS BIGINT) AS after FROM ({_SALES}) WHERE o_orderdate BETWEEN DATE '1997-12-11' AND DATE '1998-06-11' GROUP BY l_suppkey HAVING sum(CASE WHEN o_orderdate < DATE '1998-03-11' THEN l_quantity ELSE 0 END) > 0")
_add("best_customers_of_frequent_parts", f"WITH f AS (SELECT l_partkey AS p FROM {{lineitem}} GROUP BY 1 HAVING count(*) > 5), b AS (SELECT o_custkey AS c, sum(rev) AS r FROM ({_SALES}) GROUP BY 1), mx AS (SELECT max(r) AS t FROM b) SELECT y, round(sum(rev), 2) AS r, count(*) AS n FROM ({_SALES}) WHERE l_partkey IN (SELECT p FROM f) AND o_custkey IN (SELECT c FROM b, mx WHERE r > 0.5 * t) GROUP BY y")
_add("six_price_bands", "SELECT " + ", ".join(f"(SELECT round(avg(l_extendedprice), 4) FROM {{lineitem}} WHERE l_quantity BETWEEN {a} AND {a + 7}) AS avg{i}, (SELECT count(DISTINCT l_extendedprice) FROM {{lineitem}} WHERE l_quantity BETWEEN {a} AND {a + 7}) AS n{i}" for i, a in enumerate(range(1, 44, 8))))
_add("discounts_above_the_mean", f"SELECT round(sum(cut), 2) AS excess FROM ({_SALES}) s WHERE y = 1999 AND cut > (SELECT 1.3 * avg(l_extendedprice * l_discount) FROM {{lineitem}} i WHERE i.l_suppkey = s.l_suppkey)")
_add("baskets_by_size", "SELECT c_name, n FROM (SELECT o_custkey, l_orderkey, count(*) AS n FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey GROUP BY 1, 2) JOIN {customer} ON o_custkey = c_custkey WHERE n BETWEEN 9 AND 12")
_add("margin_rank_in_rollup", f"SELECT p_brand, p_type, g, lv, rk FROM (SELECT p_brand, p_type, round(sum(cut) / sum(l_extendedprice), 8) AS g, CAST(grouping(p_brand) + grouping(p_type) AS BIGINT) AS lv, CAST(rank() OVER (PARTITION BY grouping(p_brand) + grouping(p_type), CASE WHEN grouping(p_type) = 0 THEN p_brand END ORDER BY round(sum(cut) / sum(l_extendedprice), 8)) AS BIGINT) AS rk FROM ({_SALES}) JOIN {{part}} ON l_partkey = p_partkey GROUP BY ROLLUP (p_brand, p_type))")
_add("variation_in_two_months", f"WITH v AS (SELECT l_suppkey AS s, m, avg(l_quantity) AS a, stddev_samp(l_quantity) AS d FROM ({_SALES}) GROUP BY 1, 2) SELECT x.s, x.m, round(x.d / x.a, 6) AS c1, round(z.d / z.a, 6) AS c2 FROM v x JOIN v z ON x.s = z.s AND z.m = x.m + 1 WHERE x.d / x.a > 0.55 AND z.d / z.a > 0.55")
_add("names_with_conditions", "SELECT DISTINCT p_name FROM {part} p WHERE p_size BETWEEN 10 AND 30 AND (SELECT count(*) FROM {part} i WHERE i.p_brand = p.p_brand AND (i.p_type = 'ECONOMY' AND i.p_size < 12 OR i.p_type = 'STANDARD' AND i.p_size > 40)) > 0")
_add("weekday_pivot", "SELECT o_orderstatus, " + ", ".join(f"round(sum(CASE WHEN dayofweek(o_orderdate) = {d} THEN o_totalprice END), 2) AS d{d}" for d in range(2, 6)) + " FROM {orders} GROUP BY o_orderstatus")
_add("best_and_worst", "WITH a AS (SELECT l_partkey AS p, avg(l_extendedprice / l_quantity) AS v FROM {lineitem} GROUP BY 1 HAVING count(*) > 2), b AS (SELECT p, CAST(row_number() OVER (ORDER BY v DESC, p) AS BIGINT) AS r FROM a), w AS (SELECT p, CAST(row_number() OVER (ORDER BY v, p) AS BIGINT) AS r FROM a) SELECT b.r, x.p_name AS best, z.p_name AS worst, b.p AS bp, w.p AS wp FROM b JOIN w ON b.r = w.r JOIN {part} x ON x.p_partkey = b.p JOIN {part} z ON z.p_partkey = w.p WHERE b.r <= 10")
_add("bought_away_from_home", f"SELECT l_orderkey, round(sum(rev), 2) AS r FROM ({_SALES}) JOIN {{customer}} ON o_custkey = c_custkey JOIN {{supplier}} ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey AND dayofweek(o_orderdate) IN (1, 7) GROUP BY l_orderkey HAVING sum(rev) > 150000")
_add("previous_and_next_month", f"WITH v AS (SELECT p_brand, y, m, sum(rev) AS r, avg(sum(rev)) OVER (PARTITION BY p_brand, y) AS a, rank() OVER (PARTITION BY p_brand ORDER BY y, m) AS k FROM ({_SALES}) JOIN {{part}} ON l_partkey = p_partkey GROUP BY 1, 2, 3) SELECT v.p_brand, v.y, v.m, round(v.r, 2) AS r, round(b.r, 2) AS before, round(f.r, 2) AS after FROM v JOIN v b ON b.p_brand = v.p_brand AND b.k = v.k - 1 JOIN v f ON f.p_brand = v.p_brand AND f.k = v.k + 1 WHERE v.y = 1997 AND abs(v.r - v.a) > 0.4 * v.a")
_add("worst_return_ratios", f"SELECT ch, p, k FROM (SELECT ch, p, CAST(rank() OVER (PARTITION BY ch ORDER BY ratio, p) AS BIGINT) AS k FROM (SELECT l_linestatus AS ch, l_partkey AS p, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity) AS ratio FROM ({_SALES}) GROUP BY 1, 2 HAVING sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) > 0)) WHERE k <= 10")
_add("shipping_day_bands", "SELECT l_returnflag, " + ", ".join(f"CAST(sum(CASE WHEN {_DAYS} > {a} AND {_DAYS} <= {b} THEN 1 ELSE 0 END) AS BIGINT) AS b{i}" for i, (a, b) in enumerate(((-1, 20), (20, 40), (40, 60), (60, 80), (80, 9999)))) + f" FROM ({_SALES}) GROUP BY l_returnflag")
_add("far_from_the_quarter_mean", f"SELECT p_brand, q, r, a FROM (SELECT p_brand, q, round(sum(rev), 2) AS r, round(avg(sum(rev)) OVER (PARTITION BY p_brand), 2) AS a FROM ({_SALES}) JOIN {{part}} ON l_partkey = p_partkey WHERE y = 1998 GROUP BY 1, 2) WHERE abs(r - a) > 0.15 * a")
_add("alike_in_three_channels", f"WITH a AS ({_channel('N', 'l_partkey AS p, sum(rev) AS r', '1')}), b AS ({_channel('A', 'l_partkey AS p, sum(rev) AS r', '1')}), c AS ({_channel('R', 'l_partkey AS p, sum(rev) AS r', '1')}) SELECT a.p, round((a.r + b.r + c.r) / 3, 2) AS mean FROM a JOIN b ON a.p = b.p JOIN c ON a.p = c.p WHERE a.r BETWEEN 0.6 * b.r AND 1.6 * b.r AND b.r BETWEEN 0.6 * c.r AND 1.6 * c.r AND a.r BETWEEN 0.6 * c.r AND 1.6 * c.r")
_add("sum_over_three_channels", f"SELECT p_brand, round(sum(r), 2) AS r FROM ({_channel('N', 'l_partkey AS p, sum(rev) AS r', '1')} UNION ALL {_channel('A', 'l_partkey, sum(rev)', '1')} UNION ALL {_channel('R', 'l_partkey, sum(rev)', '1')}) JOIN {{part}} ON p = p_partkey WHERE p_type = 'ECONOMY' GROUP BY p_brand")
_add("promotion_share", f"SELECT y, round(sum(CASE WHEN l_discount >= 0.05 THEN rev ELSE 0 END) * 100 / sum(rev), 6) AS share FROM ({_SALES}) GROUP BY y")
_add("suppliers_far_below_their_mean", f"WITH t AS (SELECT l_suppkey AS s, l_partkey AS p, sum(rev) AS r FROM ({_SALES}) GROUP BY 1, 2), a AS (SELECT s, avg(r) AS a FROM t GROUP BY s) SELECT t.s, count(*) AS n FROM t JOIN a ON t.s = a.s WHERE r <= 0.1 * a GROUP BY t.s")
_add("month_pivot", "SELECT s_name, " + ", ".join(f"round(sum(CASE WHEN m = {k} THEN rev ELSE 0 END), 2) AS m{k:02}" for k in range(1, 13)) + f" FROM ({_SALES}) JOIN {{supplier}} ON l_suppkey = s_suppkey WHERE y = 1999 GROUP BY s_name")
_add("top_of_each_class", f"SELECT * FROM (SELECT p_type, p_brand, y, round(sum(rev), 2) AS r, CAST(rank() OVER (PARTITION BY p_type ORDER BY round(sum(rev), 2) DESC) AS BIGINT) AS k FROM ({_SALES}) JOIN {{part}} ON l_partkey = p_partkey GROUP BY ROLLUP (p_type, p_brand, y)) WHERE k <= 10")
_add("hours_of_events", "SELECT " + ", ".join(f"(SELECT count(*) FROM {{events}} WHERE hour(ts) = {h} AND event_type = 'purchase') AS h{h:02}" for h in range(8, 16)))
_add("morning_to_evening", "SELECT round(CAST(a AS DOUBLE) / b, 6) AS ratio FROM (SELECT count(*) AS a FROM {events} WHERE hour(ts) BETWEEN 8 AND 9), (SELECT count(*) AS b FROM {events} WHERE hour(ts) BETWEEN 19 AND 20)")
_add("promoted_and_not", f"SELECT p_type, {_WEEK} AS wk, count(CASE WHEN l_discount < 0.05 THEN 1 END) AS plain, count(CASE WHEN l_discount >= 0.05 THEN 1 END) AS promoted, count(*) AS n FROM ({_SALES}) JOIN {{part}} ON l_partkey = p_partkey WHERE {_DAYS} > 30 GROUP BY 1, 2")
_add("falling_parts", f"WITH t AS (SELECT y, l_partkey AS p, sum(l_quantity) AS c, sum(rev) AS r FROM ({_SALES}) GROUP BY 1, 2) SELECT a.p, CAST(a.c - b.c AS BIGINT) AS c, round(a.r - b.r, 2) AS r FROM t a JOIN t b ON a.p = b.p AND a.y = 1998 AND b.y = 1997 WHERE a.c / b.c < 0.3")
_add("missing_keys_by_channel", f"SELECT ch, y, count(*) AS n, round(sum(rev), 2) AS r FROM (SELECT 'store' AS ch, y, nullif(l_suppkey % 5, 0) AS k, rev FROM ({_SALES}) UNION ALL SELECT 'web', y, nullif(l_partkey % 7, 0), rev FROM ({_SALES})) WHERE k IS NULL GROUP BY ch, y")
_add("profit_and_loss_full_join", f"WITH s AS ({_channel('N', 'l_suppkey AS k, sum(rev) AS r', '1')}), t AS ({_channel('R', 'l_suppkey AS k, sum(cut) AS c', '1')}) SELECT coalesce(s.k, t.k) AS k, round(coalesce(r, 0), 2) AS r, round(coalesce(r, 0) - coalesce(c, 0), 2) AS profit FROM s FULL JOIN t ON s.k = t.k")
_add("sales_without_returns", f"WITH s AS (SELECT o_custkey AS c, y, sum(l_quantity) AS n FROM ({_SALES}) a WHERE l_returnflag = 'N' AND NOT EXISTS (SELECT 1 FROM {{lineitem}} z WHERE z.l_orderkey = a.l_orderkey AND z.l_returnflag = 'R') GROUP BY 1, 2), t AS (SELECT o_custkey AS c, y, sum(l_quantity) AS n FROM ({_SALES}) WHERE l_returnflag = 'A' GROUP BY 1, 2) SELECT s.c, s.y, round(s.n / t.n, 6) AS ratio FROM s LEFT JOIN t ON s.c = t.c AND s.y = t.y WHERE coalesce(t.n, 0) > 0")
_add("channel_overlap", "WITH a AS (SELECT DISTINCT o_custkey AS c, l_partkey AS p FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_returnflag = 'N'), b AS (SELECT DISTINCT o_custkey AS c, l_partkey AS p FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_returnflag = 'A') SELECT count(CASE WHEN a.c IS NOT NULL AND b.c IS NULL THEN 1 END) AS only_a, count(CASE WHEN a.c IS NULL AND b.c IS NOT NULL THEN 1 END) AS only_b, count(CASE WHEN a.c IS NOT NULL AND b.c IS NOT NULL THEN 1 END) AS in_both FROM a FULL JOIN b ON a.c = b.c AND a.p = b.p")
_add("suppliers_that_ship_all_types", "SELECT l_suppkey FROM {lineitem} JOIN {part} ON l_partkey = p_partkey GROUP BY l_suppkey HAVING count(DISTINCT p_type) = (SELECT count(DISTINCT p_type) FROM {part})")
_add("quarter_growth_in_two_channels", f"WITH t AS (SELECT l_returnflag AS ch, l_suppkey AS s, q, sum(rev) AS r FROM ({_SALES}) WHERE y = 1998 GROUP BY 1, 2, 3) SELECT a.s, round(b.r / a.r, 6) AS g1, round(d.r / c.r, 6) AS g2 FROM t a JOIN t b ON a.s = b.s AND a.ch = 'N' AND b.ch = 'N' AND a.q = 1 AND b.q = 2 JOIN t c ON c.s = a.s AND c.ch = 'R' AND c.q = 1 JOIN t d ON d.s = a.s AND d.ch = 'R' AND d.q = 2 WHERE b.r / a.r > d.r / c.r")
