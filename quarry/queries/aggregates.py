"""Aggregation, grouping sets, pivots, statistics and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import windows as W
from .registry import Catalog, table

C = Catalog()

C.sql("agg_group_by", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q, round(avg(l_discount), 6) AS d, count(*) AS n, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM {lineitem} GROUP BY l_returnflag, l_linestatus")
C.sql("agg_global", "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS s, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day FROM {orders}")
C.sql("agg_global_empty", "SELECT count(*) AS n, sum(o_totalprice) AS s FROM {orders} WHERE o_totalprice < 0")
C.sql("agg_count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS s, count(DISTINCT l_partkey) AS p FROM {lineitem} GROUP BY l_returnflag")
C.sql("agg_count_distinct_pair", "SELECT count(DISTINCT l_partkey, l_suppkey) AS n FROM {lineitem}", "SELECT count(*) AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM {lineitem})")
C.sql("agg_sum_distinct", "SELECT o_orderstatus, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS s FROM {orders} GROUP BY o_orderstatus")
C.sql("agg_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS o FROM {orders} GROUP BY o_orderpriority")
C.sql("agg_having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > 15")
C.sql("agg_ordinal_alias_all", "SELECT o_orderstatus AS st, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ALL")
C.sql("agg_rollup", "SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS BIGINT) AS g1, CAST(grouping(o_orderpriority) AS BIGINT) AS g2, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
C.sql("agg_cube", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)")
C.sql("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, CAST(grouping_id(l_returnflag, l_linestatus, l_linenumber) AS BIGINT) AS gid FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())",
      "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, CAST(grouping_id(l_returnflag, l_linestatus, l_linenumber) AS BIGINT) AS gid FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())")
C.sql("agg_stddev_variance", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sp, round(var_samp(l_quantity), 6) AS vs, round(var_pop(l_quantity), 6) AS vp FROM {lineitem} GROUP BY l_returnflag")
C.sql("agg_corr_covar", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_discount), 6) AS cp, round(covar_samp(l_quantity, l_discount), 6) AS cs FROM {lineitem}")
C.sql("agg_regression", "SELECT regr_count(l_extendedprice, l_quantity) AS n, round(regr_slope(l_extendedprice, l_quantity), 3) AS sl, round(regr_intercept(l_extendedprice, l_quantity), 2) AS ic, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, round(regr_avgx(l_extendedprice, l_quantity), 4) AS ax, round(regr_avgy(l_extendedprice, l_quantity), 2) AS ay FROM {lineitem}")
C.sql("agg_regression_sums", "SELECT round(regr_sxx(l_discount, l_quantity) / 1000, 2) AS sxx, round(regr_sxy(l_discount, l_quantity), 2) AS sxy, round(regr_syy(l_discount, l_quantity), 4) AS syy FROM {lineitem}")
C.sql("agg_percentile_cont_disc", "SELECT o_orderstatus, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY o_totalprice), 4) AS p25, percentile_disc(0.5) WITHIN GROUP (ORDER BY o_totalprice) AS p50 FROM {orders} GROUP BY o_orderstatus",
      "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.25), 4) AS p25, quantile_disc(o_totalprice, 0.5) AS p50 FROM {orders} GROUP BY o_orderstatus")
C.sql("agg_median_percentile", "SELECT c_mktsegment, round(median(c_acctbal), 4) AS m, round(percentile(c_acctbal, 0.9), 4) AS p FROM {customer} GROUP BY c_mktsegment",
      "SELECT c_mktsegment, round(median(c_acctbal), 4) AS m, round(quantile_cont(c_acctbal, 0.9), 4) AS p FROM {customer} GROUP BY c_mktsegment")
C.sql("agg_skewness", "SELECT l_returnflag, round(skewness(l_quantity), 6) AS sk FROM {lineitem} GROUP BY l_returnflag",
      "SELECT l_returnflag, round((avg(l_quantity ** 3) - 3 * avg(l_quantity) * avg(l_quantity ** 2) + 2 * avg(l_quantity) ** 3) / var_pop(l_quantity) ** 1.5, 6) AS sk FROM {lineitem} GROUP BY l_returnflag")
C.sql("agg_kurtosis", "SELECT l_returnflag, round(kurtosis(l_quantity), 6) AS k FROM {lineitem} GROUP BY l_returnflag", "SELECT l_returnflag, round(kurtosis_pop(l_quantity), 6) AS k FROM {lineitem} GROUP BY l_returnflag")
C.sql("agg_bool", "SELECT o_orderpriority, bool_and(o_totalprice > 0) AS a, bool_or(o_totalprice > 300000) AS b, every(o_custkey > 0) AS c, some(o_orderstatus = 'P') AS d FROM {orders} GROUP BY o_orderpriority",
      "SELECT o_orderpriority, bool_and(o_totalprice > 0) AS a, bool_or(o_totalprice > 300000) AS b, bool_and(o_custkey > 0) AS c, bool_or(o_orderstatus = 'P') AS d FROM {orders} GROUP BY o_orderpriority")
C.sql("agg_bits", "SELECT n_regionkey, bit_and(n_nationkey) AS a, bit_or(n_nationkey) AS o, bit_xor(n_nationkey) AS x FROM {nation} GROUP BY n_regionkey")
C.sql("agg_min_max_by", "SELECT o_orderstatus, max_by(o_orderkey, o_totalprice) AS hi, min_by(o_orderkey, o_totalprice) AS lo FROM {orders} GROUP BY o_orderstatus", "SELECT o_orderstatus, arg_max(o_orderkey, o_totalprice) AS hi, arg_min(o_orderkey, o_totalprice) AS lo FROM {orders} GROUP BY o_orderstatus")
C.sql("agg_mode", "SELECT o_orderstatus, mode() WITHIN GROUP (ORDER BY o_orderpriority) AS m FROM {orders} GROUP BY o_orderstatus",
      "SELECT o_orderstatus, o_orderpriority AS m FROM (SELECT o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, o_orderpriority) AS r FROM {orders} GROUP BY 1, 2) WHERE r = 1")
C.sql("agg_listagg", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey")
C.sql("agg_collect", "SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), '|') AS l, CAST(size(collect_set(n_nationkey % 2)) AS BIGINT) AS s FROM {nation} GROUP BY n_regionkey",
      "SELECT n_regionkey, array_to_string(list_sort(list(n_name)), '|') AS l, count(DISTINCT n_nationkey % 2) AS s FROM {nation} GROUP BY n_regionkey")
C.sql("agg_count_if_any_value", "SELECT o_orderstatus, count_if(o_totalprice > 100000) AS n, any_value(o_orderstatus, true) AS v FROM {orders} GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(count_if(o_totalprice > 100000) AS BIGINT) AS n, any_value(o_orderstatus) AS v FROM {orders} GROUP BY o_orderstatus")
C.sql("agg_try_sum_avg", "SELECT n_regionkey, try_sum(n_nationkey) AS s, try_avg(n_nationkey) AS a, try_sum(9223372036854775807 - n_nationkey) AS over FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, CAST(sum(n_nationkey) AS BIGINT) AS s, avg(n_nationkey) AS a, CAST(NULL AS BIGINT) AS over FROM {nation} GROUP BY n_regionkey")
C.sql("agg_decimal", "SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(1 - l_discount AS DECIMAL(4,2))) AS DECIMAL(38,4)) AS s FROM {lineitem} GROUP BY l_returnflag")
C.sql("agg_high_cardinality", "SELECT l_orderkey, count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM {lineitem} GROUP BY l_orderkey")
C.sql("agg_approx_within_bound", "SELECT l_returnflag, count(DISTINCT l_partkey) AS n, abs(approx_count_distinct(l_partkey) - count(DISTINCT l_partkey)) <= 0.15 * count(DISTINCT l_partkey) AS close FROM {lineitem} GROUP BY l_returnflag", "SELECT l_returnflag, count(DISTINCT l_partkey) AS n, true AS close FROM {lineitem} GROUP BY l_returnflag")
C.sql("agg_hll_within_bound", "SELECT l_linestatus, count(DISTINCT l_orderkey) AS n, abs(hll_sketch_estimate(hll_sketch_agg(l_orderkey, 12)) - count(DISTINCT l_orderkey)) <= 0.1 * count(DISTINCT l_orderkey) AS close FROM {lineitem} GROUP BY l_linestatus", "SELECT l_linestatus, count(DISTINCT l_orderkey) AS n, true AS close FROM {lineitem} GROUP BY l_linestatus")
C.sql("agg_hll_union", "SELECT max(n) AS n, abs(hll_sketch_estimate(hll_union_agg(s)) - max(n)) <= 0.1 * max(n) AS close FROM (SELECT hll_sketch_agg(l_orderkey) AS s FROM {lineitem} GROUP BY l_returnflag), (SELECT count(DISTINCT l_orderkey) AS n FROM {lineitem})", "SELECT count(DISTINCT l_orderkey) AS n, true AS close FROM {lineitem}")
C.sql("agg_percentile_approx_bound", "SELECT l_returnflag, CAST(percentile_approx(l_quantity, 0.5, 100000) AS BIGINT) AS median FROM {lineitem} GROUP BY l_returnflag", "SELECT l_returnflag, CAST(quantile_disc(l_quantity, 0.5) AS BIGINT) AS median FROM {lineitem} GROUP BY l_returnflag")
C.sql("agg_histogram_count_min", "SELECT l_returnflag, CAST(aggregate(histogram_numeric(l_quantity, 5), 0D, (a, b) -> a + b.y) AS BIGINT) AS n, size(histogram_numeric(l_quantity, 5)) AS bins, length(hex(count_min_sketch(l_linenumber, 0.1D, 0.9D, 1))) > 0 AS sketch FROM {lineitem} GROUP BY l_returnflag",
      "SELECT l_returnflag, count(*) AS n, CAST(5 AS INTEGER) AS bins, true AS sketch FROM {lineitem} GROUP BY l_returnflag")


@C.frame("agg_two_phase", "SELECT l_suppkey, round(sum(l_extendedprice), 2) AS s, round(avg(l_quantity), 6) AS a, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def _(spark, d):
    from ..operators.aggregates import two_phase

    return two_phase(table(spark, d, "lineitem"), ["l_suppkey"], salts=4).select("l_suppkey", F.round("s", 2).alias("s"), F.round("a", 6).alias("a"), "n")


@C.frame("agg_rollup_api", "SELECT n_regionkey, n_nationkey, count(*) AS n FROM nation GROUP BY ROLLUP (n_regionkey, n_nationkey)")
def _(spark, d):
    return table(spark, d, "nation").rollup("n_regionkey", "n_nationkey").agg(F.count("*").alias("n"))


@C.frame("agg_cube_api", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def _(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@C.frame("agg_grouping_sets_api", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))")
def _(spark, d):
    return table(spark, d, "orders").groupingSets([["o_orderstatus"], ["o_orderpriority"]], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@C.frame("agg_pivot", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\" FROM orders GROUP BY o_orderpriority")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O"]).agg(F.count("o_orderpriority")).na.fill(0)


C.sql("agg_pivot_sql", "SELECT * FROM (SELECT n_regionkey, n_nationkey % 2 AS odd FROM {nation}) PIVOT (count(*) FOR odd IN (0 AS even, 1 AS odd))", "SELECT n_regionkey, count(*) FILTER (n_nationkey % 2 = 0) AS even, count(*) FILTER (n_nationkey % 2 = 1) AS odd FROM {nation} GROUP BY n_regionkey")


def _stats(col: str, src: str, names: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS summary, round(CAST({e} AS DOUBLE), 6) AS {col} FROM {src}" for k, e in names.items())


_FIVE = {"count": "count({0})", "mean": "avg({0})", "stddev": "stddev_samp({0})", "min": "min({0})", "max": "max({0})"}


@C.frame("stat_describe", _stats("o_custkey", "orders", {k: v.format("o_custkey") for k, v in _FIVE.items()}))
def _(spark, d):
    return table(spark, d, "orders").describe("o_custkey").select("summary", F.round(F.col("o_custkey").cast("double"), 6).alias("o_custkey"))


@C.frame("stat_summary", _stats("l_linenumber", "lineitem", {k: v.format("l_linenumber") for k, v in _FIVE.items()} | {f"{p}%": f"quantile_disc(l_linenumber, 0.{p})" for p in (25, 50, 75)}))
def _(spark, d):
    return table(spark, d, "lineitem").select("l_linenumber").summary().select("summary", F.round(F.col("l_linenumber").cast("double"), 6).alias("l_linenumber"))


@C.frame("stat_crosstab", "SELECT o_orderstatus AS o_orderstatus_p, " + ", ".join(f"count(*) FILTER (o_orderpriority[1:1] = '{p}') AS \"{p}\"" for p in range(1, 6)) + " FROM orders GROUP BY 1")
def _(spark, d):
    return table(spark, d, "orders").withColumn("p", F.left("o_orderpriority", F.lit(1))).crosstab("o_orderstatus", "p")


@C.frame("stat_corr_cov", "SELECT round(corr(l_extendedprice, l_quantity), 6) AS c, round(covar_samp(l_quantity, l_tax), 6) AS v, round(covar_pop(l_quantity, l_tax), 6) AS p FROM lineitem")
def _(spark, d):
    li = table(spark, d, "lineitem")
    own = li.agg(F.round(F.covar_pop("l_quantity", "l_tax"), 6).alias("p"))
    return own.withColumns({"c": F.lit(round(li.stat.corr("l_extendedprice", "l_quantity"), 6)), "v": F.lit(round(li.stat.cov("l_quantity", "l_tax"), 6))})


@C.frame("stat_approx_quantile", "SELECT quantile_disc(l_quantity, 0.25) AS lo, quantile_disc(l_quantity, 0.75) AS hi FROM lineitem")
def _(spark, d):  # an error of zero asks for the exact quantiles
    return spark.createDataFrame([tuple(table(spark, d, "lineitem").stat.approxQuantile("l_quantity", [0.25, 0.75], 0.0))], "lo double, hi double")


@C.frame("stat_freq_items", "SELECT l_returnflag AS item FROM lineitem GROUP BY 1 HAVING count(*) >= 0.3 * (SELECT count(*) FROM lineitem)")
def _(spark, d):  # none that is frequent may be missing; others may come up
    li = table(spark, d, "lineitem")
    found = li.stat.freqItems(["l_returnflag"], 0.3).select(F.explode("l_returnflag_freqItems").alias("item"))
    n = li.groupBy(F.col("l_returnflag").alias("item")).agg(F.count("*").alias("n"))
    return found.join(n, "item").join(li.agg(F.count("*").alias("all"))).where("n >= 0.3 * all").select("item")


# -- windows ------------------------------------------------------------------------------

_O = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
C.sql("win_ranking", f"SELECT o_orderkey, CAST(row_number() OVER ({_O}) AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS BIGINT) AS dr FROM {{orders}}")
C.sql("win_distribution", f"SELECT o_orderkey, round(percent_rank() OVER ({_O}), 6) AS pr, round(cume_dist() OVER ({_O}), 6) AS cd, CAST(ntile(4) OVER ({_O}) AS BIGINT) AS nt FROM {{orders}}")
C.sql("win_lag_lead", f"SELECT o_orderkey, lag(o_orderkey) OVER ({_O}) AS l1, lead(o_orderkey, 2, -1) OVER ({_O}) AS l2 FROM {{orders}}")
C.sql("win_first_last_nth", f"SELECT o_orderkey, first_value(o_orderkey) OVER ({_O}) AS f, last_value(o_orderkey) OVER ({_O} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(o_orderkey, 2) OVER ({_O}) AS n2 FROM {{orders}}")
C.sql("win_rows_frame", f"SELECT o_orderkey, round(sum(o_totalprice) OVER ({_O} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s3, count(*) OVER ({_O} ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS ahead FROM {{orders}}")
C.sql("win_range_frame", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM {part}")
C.sql("win_range_interval", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS day_events FROM {events}", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS day_events FROM {events}")
C.sql("win_running_total", f"SELECT o_orderkey, round(sum(o_totalprice) OVER ({_O} ROWS UNBOUNDED PRECEDING), 2) AS total FROM {{orders}}")
C.sql("win_share", "SELECT p_partkey, round(p_retailprice / sum(p_retailprice) OVER (PARTITION BY p_brand), 8) AS share FROM {part}")
C.sql("win_top_n", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM {orders}) WHERE r <= 3")
C.sql("win_named", "SELECT o_orderkey, count(*) OVER w AS n, max(o_totalprice) OVER w AS hi FROM {orders} WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey)")
C.sql("win_ignore_nulls", "SELECT event_id, last_value(v) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_v FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN event_id END AS v FROM {events})",
      "SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_v FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN event_id END AS v FROM {events})")
C.sql("win_statistics", "SELECT p_partkey, round(stddev_samp(p_retailprice) OVER (PARTITION BY p_brand), 4) AS sd, round(covar_pop(p_size, p_retailprice) OVER (PARTITION BY p_brand), 3) AS cp FROM {part}")


@C.frame("win_sessions", """SELECT user_id, min(event_id) AS first_event, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
  (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")  # fmt: skip
def _(spark, d):
    s = W.sessionize(table(spark, d, "events"), "user_id", "ts", "event_id", "INTERVAL 12 HOUR")
    return s.groupBy("user_id", "session").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n")).drop("session")


@C.frame("win_api_frames", "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS m FROM orders")
def _(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(-1, 1)
    return table(spark, d, "orders").select("o_orderkey", F.round(F.avg("o_totalprice").over(w), 4).alias("m"))


@C.frame("win_gap_fill", """WITH b AS (SELECT user_id, min(date_trunc('day', ts)) AS lo, max(date_trunc('day', ts)) AS hi FROM events GROUP BY user_id),
  g AS (SELECT user_id, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS day FROM b) SELECT g.user_id, CAST(g.day AS DATE) AS day, count(event_id) AS n FROM g
  LEFT JOIN events e ON e.user_id = g.user_id AND date_trunc('day', e.ts) = g.day GROUP BY g.user_id, g.day""")  # fmt: skip
def _(spark, d):
    return W.daily_counts(table(spark, d, "events"), "user_id", "ts")
