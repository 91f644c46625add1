"""Scans, projections, predicates, sorting, limits, set operations, missing values and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import Catalog, table

C = Catalog()

C.sql("scan_projection", "SELECT l_orderkey, l_linenumber, l_quantity FROM {lineitem}")
C.sql("scan_filter_pushdown", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM {lineitem} WHERE l_quantity >= 45 AND l_discount BETWEEN 0.03 AND 0.07 AND l_returnflag = 'R'")
C.sql("scan_in_list", "SELECT o_orderkey, o_orderpriority FROM {orders} WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P')")
C.sql("scan_like", "SELECT p_partkey, p_name, p_type FROM {part} WHERE p_type LIKE '%E%' AND p_name NOT LIKE '%ring'")
C.sql("scan_ilike", "SELECT c_custkey, c_mktsegment FROM {customer} WHERE c_mktsegment ILIKE '%build%'")
C.sql("scan_like_any_all", "SELECT c_custkey FROM {customer} WHERE c_mktsegment LIKE ANY ('%A%', 'B%') AND c_name NOT LIKE ALL ('%7', '%8')",
      "SELECT c_custkey FROM {customer} WHERE (c_mktsegment LIKE '%A%' OR c_mktsegment LIKE 'B%') AND c_name NOT LIKE '%7' AND c_name NOT LIKE '%8'")
C.sql("scan_rlike", "SELECT c_custkey FROM {customer} WHERE c_name RLIKE '#0+[1-9]*[0-4]$'", "SELECT c_custkey FROM {customer} WHERE regexp_matches(c_name, '#0+[1-9]*[0-4]$')")
C.sql("scan_null_tests", "SELECT doc_id, lang IS NULL AS no_lang, lang IS NOT NULL AS has_lang, lang IS DISTINCT FROM 'en' AS not_en FROM {documents}")
C.sql("scan_case", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS bucket, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code FROM {orders}")
C.sql("scan_arithmetic", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 1) AS charge, CAST(l_linenumber % 3 AS BIGINT) AS rest, round(l_quantity / 7, 4) AS seventh, -l_linenumber AS neg FROM {lineitem}")
C.sql("scan_cast", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, CAST(l_shipdate AS DATE) AS d, CAST(l_orderkey AS STRING) AS s, CAST(l_extendedprice AS DECIMAL(15,2)) AS m FROM {lineitem}")
C.sql("scan_range_function", "SELECT id, id * id AS sq FROM range(1, 200, 7)", "SELECT range AS id, range * range AS sq FROM range(1, 200, 7)")
C.sql("scan_values", "SELECT a, b FROM VALUES (1, 'x'), (2, 'y'), (3, NULL) AS t(a, b)", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b)")
C.sql("scan_columns_except", "SELECT * EXCEPT (n_name) FROM {nation}", "SELECT * EXCLUDE (n_name) FROM nation")
C.sql("scan_pipe_syntax", "FROM {orders} |> WHERE o_totalprice > 100000 |> AGGREGATE count(*) AS n GROUP BY o_orderstatus |> SELECT o_orderstatus, n",
      "SELECT o_orderstatus, count(*) AS n FROM {orders} WHERE o_totalprice > 100000 GROUP BY o_orderstatus")

C.sql("sort_top_k", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
C.sql("sort_offset", "SELECT c_custkey, c_acctbal FROM {customer} ORDER BY c_acctbal ASC NULLS LAST, c_custkey LIMIT 20 OFFSET 15")
C.sql("sort_nulls", "SELECT doc_id, lang, CAST(row_number() OVER (ORDER BY lang ASC NULLS FIRST, doc_id DESC) AS BIGINT) AS first, CAST(row_number() OVER (ORDER BY lang DESC NULLS LAST, doc_id) AS BIGINT) AS last FROM (SELECT doc_id, nullif(lang, 'de') AS lang FROM {documents}) ORDER BY lang ASC NULLS FIRST, doc_id DESC")
C.sql("sort_ordinal_all", "SELECT n_regionkey, n_nationkey FROM {nation} ORDER BY ALL LIMIT 12")


@C.frame("sort_tail", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey DESC LIMIT 5")
def _(spark, d):
    rows = table(spark, d, "nation").orderBy("n_nationkey").select("n_nationkey", "n_name")
    return spark.createDataFrame(rows.tail(5), rows.schema)  # five rows: tail is an action that returns them


@C.frame("sort_within_partitions", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def _(spark, d):
    rows = table(spark, d, "lineitem").repartition("l_suppkey").sortWithinPartitions("l_suppkey", "l_orderkey")
    return rows.groupBy("l_suppkey").agg(F.count("*").alias("n"))  # reuses the partitioning: one exchange


C.sql("sort_distribute_cluster_by", "SELECT c_nationkey, count(*) AS n FROM (SELECT c_nationkey FROM {customer} CLUSTER BY c_nationkey) GROUP BY c_nationkey",
      "SELECT c_nationkey, count(*) AS n FROM {customer} GROUP BY c_nationkey")


@C.frame("sort_sample", "SELECT l_returnflag, count(*) AS n, true AS fair, true AS own FROM lineitem GROUP BY 1")
def _(spark, d):
    li = table(spark, d, "lineitem")
    some = li.sample(fraction=0.1, seed=7)
    got = some.groupBy("l_returnflag").agg(F.count("*").alias("s"))
    out = li.groupBy("l_returnflag").agg(F.count("*").alias("n")).join(got, "l_returnflag")
    again = li.sample(fraction=0.1, seed=7).exceptAll(some).isEmpty()  # the seed makes it definite
    return out.select("l_returnflag", "n", (F.abs(F.col("s") - F.col("n") * 0.1) <= 5 * F.sqrt(F.col("n") * 0.09)).alias("fair"), F.lit(again).alias("own"))


C.sql("sort_tablesample", "SELECT l_returnflag, n, s BETWEEN 0.1 * n AND 0.3 * n AS fair FROM (SELECT l_returnflag, count(*) AS n FROM {lineitem} GROUP BY 1) JOIN (SELECT l_returnflag, count(*) AS s FROM {lineitem} TABLESAMPLE (20 PERCENT) REPEATABLE (11) GROUP BY 1) USING (l_returnflag)", "SELECT l_returnflag, count(*) AS n, true AS fair FROM {lineitem} GROUP BY 1")


@C.frame("sort_sample_by", "SELECT o_orderstatus, count(*) AS n, true AS fair FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def _(spark, d):
    o = table(spark, d, "orders")
    got = o.stat.sampleBy("o_orderstatus", {"F": 0.5, "O": 0.1}, seed=3).groupBy("o_orderstatus").agg(F.count("*").alias("s"))
    share = F.when(F.col("o_orderstatus") == "F", 0.5).otherwise(0.1)
    out = o.groupBy("o_orderstatus").agg(F.count("*").alias("n")).join(got, "o_orderstatus")  # strata without a share have no rows
    return out.select("o_orderstatus", "n", (F.abs(F.col("s") - F.col("n") * share) <= 5 * F.sqrt(F.col("n") * share * (1 - share))).alias("fair"))


C.sql("set_union_all", "SELECT n_nationkey AS k FROM {nation} UNION ALL SELECT r_regionkey FROM {region}")
C.sql("set_union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}")
C.sql("set_intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}")
C.sql("set_except", "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT s_nationkey FROM {supplier} WHERE s_acctbal > 8000")
C.sql("set_intersect_all", "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey FROM {supplier}")
C.sql("set_except_all", "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}")
C.sql("set_minus", "SELECT c_custkey AS k FROM {customer} MINUS SELECT o_custkey FROM {orders} WHERE o_totalprice > 250000", "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders} WHERE o_totalprice > 250000")
C.sql("set_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM {lineitem}")


@C.frame("set_union_by_name", "SELECT n_nationkey AS k, n_name AS name, NULL::INTEGER AS extra FROM nation UNION ALL SELECT r_regionkey, r_name, r_regionkey FROM region")
def _(spark, d):
    n = table(spark, d, "nation").selectExpr("n_name AS name", "n_nationkey AS k")
    r = table(spark, d, "region").selectExpr("r_regionkey AS k", "r_name AS name", "r_regionkey AS extra")
    return n.unionByName(r, allowMissingColumns=True)


@C.frame("set_drop_duplicates", "SELECT DISTINCT o_custkey, o_orderstatus, year(o_orderdate)::INTEGER AS y FROM orders")
def _(spark, d):  # which row dropDuplicates keeps is open; the columns compared make all of it
    o = table(spark, d, "orders").select("o_custkey", "o_orderstatus", F.year("o_orderdate").alias("y"))
    return o.dropDuplicates(["o_custkey", "o_orderstatus", "y"])


@C.frame("set_drop_duplicates_count", "SELECT count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders)")
def _(spark, d):
    return table(spark, d, "orders").dropDuplicates(["o_custkey", "o_orderstatus"]).agg(F.count("*").alias("n"))


_GAPS = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS st, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders"


def _gaps(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("st"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")).alias("price")
    )


@C.frame("na_fill", f"SELECT o_orderkey, coalesce(st, '?') AS st, coalesce(price, 0) AS price FROM ({_GAPS})")
def _(spark, d):
    return _gaps(spark, d).na.fill("?").na.fill(0)


@C.frame("na_drop", f"SELECT * FROM ({_GAPS}) WHERE st IS NOT NULL OR price IS NOT NULL")
def _(spark, d):
    return _gaps(spark, d).na.drop(how="all", subset=["st", "price"])


@C.frame("na_drop_thresh", f"SELECT * FROM ({_GAPS}) WHERE st IS NOT NULL AND price IS NOT NULL")
def _(spark, d):
    return _gaps(spark, d).na.drop(thresh=3)


@C.frame("na_replace", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus").na.replace({"F": "final", "O": "open"}, subset=["o_orderstatus"])


@C.frame("shape_with_columns", "SELECT n_nationkey, upper(n_name) AS n_name, n_regionkey AS region, n_nationkey * 10 AS ten FROM nation")
def _(spark, d):
    n = table(spark, d, "nation")
    return n.withColumns({"n_name": F.upper("n_name"), "ten": F.col("n_nationkey") * 10}).withColumnsRenamed({"n_regionkey": "region"})


@C.frame("shape_drop_to_df", "SELECT n_nationkey AS a, n_name AS b FROM nation")
def _(spark, d):
    return table(spark, d, "nation").drop("n_regionkey").toDF("a", "b")


@C.frame("shape_unpivot", "SELECT l_returnflag, 'q' AS measure, sum(l_quantity) AS amount FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'n', CAST(count(*) AS DOUBLE) FROM lineitem GROUP BY 1")
def _(spark, d):
    wide = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").alias("q"), F.count("*").cast("double").alias("n"))
    return wide.unpivot("l_returnflag", ["q", "n"], "measure", "amount")


C.sql("shape_unpivot_sql", "SELECT n_nationkey, field, val FROM (SELECT n_nationkey, n_regionkey, n_nationkey + 1 AS nxt FROM {nation}) UNPIVOT (val FOR field IN (n_regionkey, nxt))",
      "SELECT n_nationkey, 'n_regionkey' AS field, n_regionkey AS val FROM nation UNION ALL SELECT n_nationkey, 'nxt', n_nationkey + 1 FROM nation")


@C.frame("shape_transpose", "SELECT 'r_name' AS key, max(CASE r_regionkey WHEN 0 THEN r_name END) AS \"0\", max(CASE r_regionkey WHEN 1 THEN r_name END) AS \"1\", max(CASE r_regionkey WHEN 2 THEN r_name END) AS \"2\", max(CASE r_regionkey WHEN 3 THEN r_name END) AS \"3\", max(CASE r_regionkey WHEN 4 THEN r_name END) AS \"4\" FROM region")
def _(spark, d):
    return table(spark, d, "region").transpose("r_regionkey")


C.sql("gen_explode", "SELECT o_orderkey, part FROM (SELECT o_orderkey, split(o_orderpriority, '-') AS parts FROM {orders}) LATERAL VIEW explode(parts) AS part",
      "SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS part FROM orders")
C.sql("gen_posexplode", "SELECT p_partkey, CAST(pos AS BIGINT) AS pos, piece FROM (SELECT p_partkey, split(p_type, ' ') AS a FROM {part}) LATERAL VIEW posexplode(a) AS pos, piece",
      "SELECT p_partkey, generate_subscripts(string_split(p_type, ' '), 1) - 1 AS pos, unnest(string_split(p_type, ' ')) AS piece FROM part")
C.sql("gen_explode_outer", "SELECT n_nationkey, x FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN array(1, 2) END AS a FROM {nation}) LATERAL VIEW OUTER explode(a) AS x",
      "SELECT n_nationkey, unnest([1, 2]) AS x FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT n_nationkey, NULL FROM nation WHERE n_nationkey % 2 <> 0")
C.sql("gen_inline", "SELECT n_nationkey, a, b FROM {nation} LATERAL VIEW inline(array(struct(n_nationkey AS a, 'x' AS b), struct(n_regionkey AS a, 'y' AS b))) AS a, b",
      "SELECT n_nationkey, n_nationkey AS a, 'x' AS b FROM nation UNION ALL SELECT n_nationkey, n_regionkey, 'y' FROM nation")
C.sql("gen_stack", "SELECT r_regionkey, k, v FROM {region} LATERAL VIEW stack(2, 'a', r_regionkey, 'b', r_regionkey + 10) AS k, v",
      "SELECT r_regionkey, 'a' AS k, r_regionkey AS v FROM region UNION ALL SELECT r_regionkey, 'b', r_regionkey + 10 FROM region")
C.sql("gen_json_tuple", "SELECT event_id, k FROM {events} LATERAL VIEW json_tuple(props, 'k') AS k", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
C.sql("gen_map_explode", "SELECT n_nationkey, k, v FROM {nation} LATERAL VIEW explode(map('r', n_regionkey, 'n', n_nationkey)) AS k, v",
      "SELECT n_nationkey, 'r' AS k, n_regionkey AS v FROM nation UNION ALL SELECT n_nationkey, 'n', n_nationkey FROM nation")
C.sql("gen_table_function", "SELECT n_nationkey, s.col AS x FROM {nation}, LATERAL explode(sequence(1, n_regionkey + 1)) AS s", "SELECT n_nationkey, unnest(range(1, n_regionkey + 2))::INTEGER AS x FROM nation")
