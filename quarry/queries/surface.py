"""Readers, commands, the catalog, the DataFrame API, streaming and lakehouse changes as queries with checked contents."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import udfs
from ..operators.aggregates import prefix_sums
from ..session import shared_folder
from ..sources import files
from ..streaming import pipelines as S
from .registry import Catalog, bind, table

C = Catalog()


def _folder(spark, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def _name() -> str:
    return f"t_{uuid.uuid4().hex}"


# -- readers and writers --------------------------------------------------------------------

_O = "SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS day FROM orders"
_OS = "o_orderkey long, o_orderstatus string, o_totalprice double, day date"


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").alias("day"))


def _round_trip(fmt: str, **options: str):
    def build(spark, d):
        path = _folder(spark, fmt)
        files.write(_orders(spark, d), fmt, path, **options)
        return files.read(spark, fmt, path, schema=_OS, **options)

    return build


C.frame("read_csv", _O)(_round_trip("csv", header="true", sep="|"))
C.frame("read_json", _O)(_round_trip("json"))
C.frame("read_orc", _O)(_round_trip("orc"))
C.frame("write_parquet", _O)(_round_trip("parquet", compression="zstd"))
C.frame("read_xml", _O)(_round_trip("xml", rowTag="order"))


@C.frame("read_csv_inferred", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark, d):
    path = _folder(spark, "csv")
    files.write(table(spark, d, "nation").coalesce(1), "csv", path, header="true")
    return files.read(spark, "csv", path, header="true", inferSchema="true")


@C.frame("read_text", "SELECT n_name AS value FROM nation")
def _(spark, d):
    path = _folder(spark, "text")
    files.write(table(spark, d, "nation").select("n_name"), "text", path)
    return files.read(spark, "text", path)


@C.frame("read_binary_file", "SELECT n_name AS content, CAST(length(n_name) + 1 AS BIGINT) AS length FROM nation")
def _(spark, d):
    path = _folder(spark, "binary")
    table(spark, d, "nation").select("n_name", "n_nationkey").write.partitionBy("n_nationkey").text(path)
    out = files.read(spark, "binaryFile", f"{path}/*", pathGlobFilter="*.txt")
    return out.select(F.rtrim(F.col("content").cast("string"), F.lit("\n")).alias("content"), "length")


@C.frame("read_many_paths", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT n_nationkey + 100 FROM nation")
def _(spark, d):
    one, two = _folder(spark, "json"), _folder(spark, "json")
    n = table(spark, d, "nation")
    files.write(n.selectExpr("n_nationkey AS k"), "json", one)
    files.write(n.selectExpr("n_nationkey + 100 AS k"), "json", two)
    return files.read(spark, "json", one, two, schema="k int")


@C.frame("read_hive_partitions", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    path = _folder(spark, "parts")
    files.write(_orders(spark, d).select("o_orderkey", "o_orderstatus"), "parquet", path, partition_by=["o_orderstatus"])
    return files.read_partitioned(spark, path, "o_orderstatus = 'F'")


@C.frame("read_type_bridge", "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, DATE '1970-01-01' + n_regionkey AS n_regionkey, CAST(NULL AS VARCHAR) AS extra FROM nation")
def _(spark, d):
    from pyspark.sql import types as T

    return files.adapt(table(spark, d, "nation"), T.StructType().add("N_NATIONKEY", "long").add("n_name", "string").add("n_regionkey", "date").add("extra", "string")).withColumnRenamed("N_NATIONKEY", "n_nationkey")


@C.frame("read_bucketed_join", "SELECT o_orderstatus, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(spark, d):
    one, two = _name(), _name()
    files.write_bucketed(table(spark, d, "orders").selectExpr("o_orderkey AS k", "o_orderstatus"), one, ["k"], 4)
    files.write_bucketed(table(spark, d, "lineitem").selectExpr("l_orderkey AS k"), two, ["k"], 4)
    return spark.table(one).join(spark.table(two).hint("merge"), "k").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@C.frame("inline_relation", "SELECT n_nationkey, label FROM nation JOIN (VALUES (0, 'zero'), (1, NULL), (3, 'three')) AS t(r, label) ON n_regionkey = r")
def _(spark, d):
    small = spark.createDataFrame([(0, "zero"), (1, None), (3, "three")], "r int, label string")
    return table(spark, d, "nation").join(small, F.col("n_regionkey") == F.col("r")).select("n_nationkey", "label")


# -- commands -------------------------------------------------------------------------------


@C.frame("ddl_create_using", "SELECT n_nationkey AS k, n_name AS v FROM nation")
def _(spark, d):
    t = _name()
    spark.sql(f"CREATE TABLE {t} (k INT, v STRING) USING orc OPTIONS (orc.compress 'zlib') COMMENT 'by name'")
    spark.sql(bind(f"INSERT INTO {t} (v, k) SELECT n_name, n_nationkey FROM {{nation}}", d))
    return spark.table(t)


@C.frame("ddl_external_location", "SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY 1")
def _(spark, d):
    t, path = _name(), _folder(spark, "external")
    table(spark, d, "nation").select("n_nationkey", "n_regionkey").write.parquet(path)
    spark.sql(f"CREATE TABLE {t} (n_nationkey INT, n_regionkey INT) USING parquet LOCATION '{path}'")
    out = spark.table(t).groupBy(F.col("n_regionkey").alias("r")).agg(F.count("*").alias("n"))
    kind = spark.sql(f"DESCRIBE EXTENDED {t}").where("col_name = 'Type'").first().data_type
    assert kind == "EXTERNAL", kind
    return out


@C.frame("ddl_insert_overwrite", "SELECT r_regionkey AS k FROM region")
def _(spark, d):
    t = _name()
    spark.sql(bind(f"CREATE TABLE {t} USING parquet AS SELECT n_nationkey AS k FROM {{nation}}", d))
    spark.sql(bind(f"INSERT OVERWRITE {t} SELECT r_regionkey FROM {{region}}", d))
    return spark.table(t)


@C.frame("ddl_alter_analyze", "SELECT n_nationkey AS k, CAST(NULL AS VARCHAR) AS note, 25 AS counted FROM nation")
def _(spark, d):
    t, new = _name(), _name()
    spark.sql(bind(f"CREATE TABLE {t} USING parquet AS SELECT n_nationkey AS k FROM {{nation}}", d))
    spark.sql(f"ALTER TABLE {t} ADD COLUMNS (note STRING)")
    spark.sql(f"ALTER TABLE {t} RENAME TO {new}")
    spark.sql(f"ANALYZE TABLE {new} COMPUTE STATISTICS FOR ALL COLUMNS")
    stats = spark.sql(f"DESCRIBE EXTENDED {new}").where("col_name = 'Statistics'").first().data_type
    return spark.table(new).withColumn("counted", F.lit(int(stats.split(",")[1].split()[0])))


@C.frame("ddl_views", "SELECT n_nationkey AS k, 'temp' AS kind FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_nationkey, 'global' FROM nation WHERE n_regionkey = 2 UNION ALL SELECT n_nationkey, 'stored' FROM nation WHERE n_regionkey = 3")
def _(spark, d):
    one, two, three, base = _name(), _name(), _name(), _name()
    spark.sql(bind(f"CREATE TABLE {base} USING parquet AS SELECT n_nationkey, n_regionkey FROM {{nation}}", d))
    spark.sql(f"CREATE OR REPLACE TEMP VIEW {one} AS SELECT n_nationkey AS k FROM {base} WHERE n_regionkey = 1")
    spark.sql(f"CREATE GLOBAL TEMP VIEW {two} AS SELECT n_nationkey AS k FROM {base} WHERE n_regionkey = 2")
    spark.sql(f"CREATE VIEW {three} AS SELECT n_nationkey AS k FROM {base} WHERE n_regionkey = 3")
    return spark.sql(f"SELECT k, 'temp' AS kind FROM {one} UNION ALL SELECT k, 'global' FROM global_temp.{two} UNION ALL SELECT k, 'stored' FROM {three}")


@C.frame("cmd_show_describe", "SELECT * FROM (VALUES ('columns', 'k,p'), ('partitions', 'p=1,p=2'), ('describe', 'k int,p int'), ('tables', '1'), ('create', 'true'), ('databases', 'true'), ('functions', 'true'), ('partition', 'true'), ('properties', 'x')) AS t(what, found)")
def _(spark, d):
    t = _name()
    spark.sql(f"CREATE TABLE {t} (k INT, p INT) USING parquet PARTITIONED BY (p) TBLPROPERTIES ('own' = 'x')")
    spark.sql(f"INSERT INTO {t} VALUES (1, 1), (2, 2)")
    many = lambda q, c=0: ",".join(str(r[c]) for r in spark.sql(q).collect())
    rows = [
        ("columns", many(f"SHOW COLUMNS IN {t}")), ("partitions", many(f"SHOW PARTITIONS {t}")),
        ("describe", ",".join(f"{r.col_name} {r.data_type}" for r in spark.sql(f"DESCRIBE {t}").collect()[:2])),
        ("tables", str(spark.sql(f"SHOW TABLES LIKE '{t}'").count())), ("create", str("PARTITIONED BY" in many(f"SHOW CREATE TABLE {t}")).lower()),
        ("databases", str("default" in many("SHOW DATABASES")).lower()), ("functions", str("abs" in many("SHOW FUNCTIONS LIKE 'abs'")).lower()),
        ("partition", str("p=1" in many(f"DESCRIBE EXTENDED {t} PARTITION (p = 1)", 1)).lower()), ("properties", many(f"SHOW TBLPROPERTIES {t} ('own')", 1)),
    ]
    return spark.createDataFrame(rows, "what string, found string")


@C.frame("cmd_set_reset_use_cache", "SELECT * FROM (VALUES ('set', '77'), ('reset', 'true'), ('use', 'default'), ('cached', 'true'), ('uncached', 'false'), ('dropped', 'false')) AS t(what, found)")
def _(spark, d):
    t, key = _name(), "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.sql(f"SET {key} = 77")
    rows = [("set", spark.conf.get(key))]
    spark.sql(f"RESET {key}")
    rows.append(("reset", str(spark.conf.get(key) != "77").lower()))
    spark.conf.set(key, before)
    spark.sql("USE default")
    rows.append(("use", spark.catalog.currentDatabase()))
    spark.sql(bind(f"CREATE TABLE {t} USING parquet AS SELECT * FROM {{region}}", d))
    spark.sql(f"CACHE TABLE {t}")
    rows.append(("cached", str(spark.catalog.isCached(t)).lower()))
    spark.sql(f"UNCACHE TABLE {t}")
    rows.append(("uncached", str(spark.catalog.isCached(t)).lower()))
    spark.sql(f"DROP TABLE {t}")
    rows.append(("dropped", str(spark.catalog.tableExists(t)).lower()))
    return spark.createDataFrame(rows, "what string, found string")


@C.frame("cmd_explain", "SELECT * FROM (VALUES ('pushed'), ('join')) AS t(found)")
def _(spark, d):
    text = spark.sql(bind("EXPLAIN FORMATTED SELECT n_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey WHERE n_nationkey > 3", d)).first()[0]
    found = [w for w, part in (("pushed", "GreaterThan(n_nationkey,3)"), ("join", "Join Inner"), ("join", "BroadcastHashJoin")) if part in text]
    return spark.createDataFrame([(w,) for w in sorted(set(found))], "found string")


# -- catalog, session and frames as objects -------------------------------------------------


@C.frame("catalog_api", "SELECT * FROM (VALUES ('columns', 'k:int,p:int'), ('table', 'MANAGED'), ('exists', 'true'), ('function', 'true'), ('listed', 'true'), ('recovered', '2'), ('temp dropped', 'true'), ('database', 'default'), ('catalog', 'spark_catalog')) AS t(what, found)")
def _(spark, d):
    c, t, v = spark.catalog, _name(), _name()
    spark.sql(f"CREATE TABLE {t} (k INT, p INT) USING parquet PARTITIONED BY (p)")
    spark.sql(f"INSERT INTO {t} VALUES (1, 1), (2, 2)")
    c.recoverPartitions(t)
    c.refreshTable(t)
    spark.range(1).createOrReplaceTempView(v)
    low = lambda x: str(x).lower()
    rows = [
        ("columns", ",".join(f"{x.name}:{x.dataType}" for x in c.listColumns(t))), ("table", c.getTable(t).tableType), ("exists", low(c.tableExists(t))), ("function", low(c.functionExists("abs") and c.getFunction("abs").name == "abs")),
        ("listed", low(t in {x.name for x in c.listTables()} and "abs" in {x.name for x in c.listFunctions(pattern="abs")})), ("recovered", str(spark.sql(f"SHOW PARTITIONS {t}").count())), ("temp dropped", low(c.dropTempView(v) and not c.tableExists(v))),
        ("database", c.getDatabase("default").name), ("catalog", c.currentCatalog()),
    ]
    return spark.createDataFrame(rows, "what string, found string")


@C.frame("session_conf_and_plan", "SELECT * FROM (VALUES ('all', true), ('unset', true), ('modifiable', true), ('static', false), ('tree', true), ('same', true), ('streaming', false), ('files', true), ('version', true)) AS t(what, found)")
def _(spark, d):
    n = table(spark, d, "nation").where("n_regionkey = 1")
    spark.conf.set("quarry.own", "1")
    everything = spark.conf.getAll
    spark.conf.unset("quarry.own")
    rows = [
        ("all", everything.get("quarry.own") == "1"), ("unset", spark.conf.get("quarry.own", None) is None), ("modifiable", spark.conf.isModifiable("spark.sql.shuffle.partitions")), ("static", spark.conf.isModifiable("spark.sql.warehouse.dir")),
        ("tree", "n_regionkey" in n._jdf.schema().treeString()), ("same", n.sameSemantics(table(spark, d, "nation").where("n_regionkey = 1")) and n.semanticHash() == table(spark, d, "nation").where("n_regionkey = 1").semanticHash()),
        ("streaming", n.isStreaming), ("files", n.inputFiles()[0].endswith("nation.parquet")), ("version", spark.version[0] >= "4"),
    ]
    return spark.createDataFrame(rows, "what string, found boolean")


@C.frame("df_show", "SELECT '|' || lpad(CAST(r_regionkey AS VARCHAR), 11, ' ') || '|' || lpad(r_name, 11, ' ') || '|' AS line FROM region")
def _(spark, d):
    text = table(spark, d, "region")._jdf.showString(20, 20, False)
    return spark.createDataFrame([(x,) for x in text.splitlines()[3:-1]], "line string")


@C.frame("df_checkpoint", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def _(spark, d):
    shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n")).checkpoint(eager=True)


@C.frame("df_write_v2", "SELECT n_regionkey AS r, n_nationkey AS k FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_regionkey, n_nationkey FROM nation WHERE n_nationkey >= 20")
def _(spark, d):
    t = _name()
    n = table(spark, d, "nation").selectExpr("n_regionkey AS r", "n_nationkey AS k")
    n.where("k < 10").writeTo(t).using("parquet").tableProperty("own", "1").create()
    n.where("k >= 20").write.mode("append").insertInto(t)  # the built-in catalog's file tables take appends by insertInto
    return spark.table(t)


@C.frame("df_lateral_join", "SELECT n_nationkey, m FROM nation JOIN (SELECT c_nationkey, max(c_acctbal) AS m FROM customer GROUP BY 1) ON c_nationkey = n_nationkey")
def _(spark, d):
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    best = c.where(F.col("c_nationkey") == F.col("n_nationkey").outer()).select(F.max("c_acctbal").alias("m"))
    return n.lateralJoin(best, how="left").where("m IS NOT NULL").select("n_nationkey", "m")


@C.frame("df_scalar_exists", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer) AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def _(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    mean = c.agg(F.avg("c_acctbal")).scalar()
    some = o.where((F.col("o_custkey") == F.col("c_custkey").outer()) & (F.col("o_totalprice") > 300000)).exists()
    return c.where(F.col("c_acctbal") > mean).where(some).select("c_custkey")


@C.frame("df_tvf", "SELECT n_nationkey, unnest(range(0, n_regionkey + 1))::INTEGER AS col FROM nation")
def _(spark, d):
    n = table(spark, d, "nation")
    return n.lateralJoin(spark.tvf.explode(F.sequence(F.lit(0), F.col("n_regionkey").outer()))).select("n_nationkey", "col")


@C.frame("df_map_in_arrow", "SELECT n_regionkey AS r, CAST(n_nationkey * 2 AS BIGINT) AS twice FROM nation")
def _(spark, d):
    import pyarrow as pa
    import pyarrow.compute as pc

    def double(batches):
        for b in batches:
            yield pa.record_batch([b.column(0), pc.multiply(b.column(1).cast(pa.int64()), 2)], ["r", "twice"])

    return table(spark, d, "nation").select("n_regionkey", "n_nationkey").mapInArrow(double, "r int, twice long")


@C.frame("df_observe", "SELECT count(*) AS n, max(l_quantity) AS hi FROM lineitem")
def _(spark, d):
    from pyspark.sql import Observation

    seen = Observation()
    table(spark, d, "lineitem").observe(seen, F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("hi")).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["n"], seen.get["hi"])], "n long, hi double")


@C.frame("df_to_schema", "SELECT n_name, CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation")
def _(spark, d):
    from pyspark.sql import types as T

    return table(spark, d, "nation").to(T.StructType().add("n_name", "string").add("n_nationkey", "long"))


@C.frame("df_with_field_col_regex", "SELECT n_nationkey, n_nationkey + 1 AS next, n_name, n_regionkey FROM nation")
def _(spark, d):
    n = table(spark, d, "nation")
    s = n.withColumn("s", F.struct("n_nationkey").withField("next", F.col("n_nationkey") + 1).dropFields("n_nationkey"))
    return s.select(s.colRegex("`n_.*`"), F.col("s").getField("next").alias("next"))


@C.frame("df_repartition_by_range", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice").repartitionByRange(4, "o_totalprice")
    spans = o.groupBy(F.spark_partition_id().alias("p")).agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi")).orderBy("lo").collect()  # four rows
    assert all(a.hi <= b.lo for a, b in zip(spans, spans[1:], strict=False)), spans
    return o


@C.frame("df_hints", "SELECT count(*) AS n, true AS merged, true AS hashed FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    on = F.col("l_orderkey") == F.col("o_orderkey")
    merged, hashed = li.join(o.hint("merge"), on), li.join(o.hint("shuffle_hash"), on)
    return merged.agg(F.count("*").alias("n")).withColumns({"merged": F.lit("SortMergeJoin" in plan(merged)), "hashed": F.lit("ShuffledHashJoin" in plan(hashed))})


C.sql("sort_distribute_by", "SELECT l_suppkey, count(*) AS n FROM (SELECT l_suppkey FROM {lineitem} DISTRIBUTE BY l_suppkey SORT BY l_suppkey) GROUP BY 1", "SELECT l_suppkey, count(*) AS n FROM {lineitem} GROUP BY 1")


@C.frame("agg_pivot_discovered", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def _(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus").count().na.fill(0)


C.sql("win_lag_ignore_nulls", "SELECT event_id, lag(v) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(v) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM (SELECT *, CASE WHEN event_type = 'click' THEN event_id END AS v FROM {events})",
      "SELECT event_id, lag(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM (SELECT *, CASE WHEN event_type = 'click' THEN event_id END AS v FROM {events})")
C.sql("win_ranking_types", "SELECT DISTINCT typeof(row_number() OVER (ORDER BY n_nationkey)) AS a, typeof(rank() OVER (ORDER BY n_nationkey)) AS b, typeof(ntile(2) OVER (ORDER BY n_nationkey)) AS c, typeof(percent_rank() OVER (ORDER BY n_nationkey)) AS d FROM {nation}", "SELECT 'int' AS a, 'int' AS b, 'int' AS c, 'double' AS d")


@C.frame("win_daily_running_total", "SELECT CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY date_trunc('day', ts)) AS BIGINT) AS total FROM events GROUP BY date_trunc('day', ts)")
def _(spark, d):
    days = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return prefix_sums(days, "day", "n", "total", F.date_trunc("week", "day"))


# -- types, names and errors ----------------------------------------------------------------

C.sql("expr_literals", "SELECT n_nationkey, 3Y + 2S AS small, 7L * n_nationkey AS big, 1.5D AS dbl, CAST(2.25BD AS DOUBLE) AS dec, X'4142' = CAST('AB' AS BINARY) AS bin, 'it''s' AS quote, r'a\\nb' AS raw, 'a\\tb' AS tab, DATE'2020-01-31' + INTERVAL '1' MONTH AS d, TIMESTAMP_NTZ'2020-01-01 10:00:00' + INTERVAL '1 02:03:04' DAY TO SECOND AS t FROM {nation}",
      "SELECT n_nationkey, 5 AS small, CAST(7 * n_nationkey AS BIGINT) AS big, 1.5::DOUBLE AS dbl, 2.25::DOUBLE AS dec, true AS bin, 'it''s' AS quote, 'a\\nb' AS raw, 'a' || chr(9) || 'b' AS tab, DATE '2020-02-29' AS d, TIMESTAMP '2020-01-02 12:03:04' AS t FROM {nation}")
C.sql("expr_decimal_string_compare", "SELECT c_custkey, CAST(c_acctbal AS DECIMAL(12,2)) = CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS STRING) AS same, CAST(c_acctbal AS DECIMAL(12,2)) > '5000' AS over FROM {customer}",
      "SELECT c_custkey, true AS same, CAST(c_acctbal AS DECIMAL(12,2)) > 5000 AS over FROM {customer}")


@C.frame("expr_output_names", "SELECT * FROM (VALUES (0, '(n_nationkey + 1)'), (1, 'count(1)'), (2, 'sum(DISTINCT n_regionkey)'), (3, 'n_nationkey'), (4, 'upper(n_name)'), (5, 'CASE WHEN (n_nationkey > 1) THEN a ELSE b END')) AS t(i, name)")
def _(spark, d):
    one = spark.sql(bind("SELECT n_nationkey + 1, CAST(n_nationkey AS STRING), upper(n_name), CASE WHEN n_nationkey > 1 THEN 'a' ELSE 'b' END FROM {nation}", d)).columns
    two = spark.sql(bind("SELECT count(*), sum(DISTINCT n_regionkey) FROM {nation}", d)).columns
    return spark.createDataFrame(list(enumerate([one[0], *two, *one[1:]])), "i int, name string")


#: Statements that must fail, and the condition they fail with.
_ERRORS = {
    "SELECT n_nationkey / (n_regionkey - n_regionkey) FROM {nation}": "DIVIDE_BY_ZERO",
    "SELECT CAST(n_nationkey AS DECIMAL(5,1)) / (n_regionkey - n_regionkey) FROM {nation}": "DIVIDE_BY_ZERO",
    "SELECT CAST(n_nationkey AS DOUBLE) / (n_regionkey - n_regionkey) FROM {nation}": "DIVIDE_BY_ZERO",
    "SELECT n_nationkey % (n_regionkey - n_regionkey) FROM {nation}": "REMAINDER_BY_ZERO",
    "SELECT 9223372036854775807 - n_nationkey + 100 FROM {nation}": "ARITHMETIC_OVERFLOW",
    "SELECT CAST(n_nationkey + 2147483647 AS INT) FROM {nation}": "ARITHMETIC_OVERFLOW",
    "SELECT CAST(n_name AS INT) FROM {nation}": "CAST_INVALID_INPUT",
    "SELECT n_nationkey IN (DATE '2020-01-01') FROM {nation}": "DATATYPE_MISMATCH.DATA_DIFF_TYPES",
    "SELECT array(1, 2)[n_nationkey] FROM {nation}": "INVALID_ARRAY_INDEX",
    "SELECT count(DISTINCT n_name) OVER (PARTITION BY n_regionkey) FROM {nation}": "DISTINCT_WINDOW_FUNCTION_UNSUPPORTED",
    "SELECT n_nationkey FROM {nation} QUALIFY row_number() OVER (ORDER BY n_nationkey) = 1": "PARSE_SYNTAX_ERROR",
    "SELECT nope FROM {nation}": "UNRESOLVED_COLUMN.WITH_SUGGESTION",
    "SELECT n_name, count(*) FROM {nation}": "MISSING_GROUP_BY",
    "SELECT percentile_cont(0.5) FROM {nation}": "INVALID_WITHIN_GROUP_EXPRESSION.WITHIN_GROUP_MISSING",
    "SELECT percentile_cont(0.5) WITHIN GROUP (ORDER BY n_nationkey) OVER (ORDER BY n_regionkey) FROM {nation}": "INVALID_WINDOW_SPEC_FOR_AGGREGATION_FUNC",
    "SELECT sum(n_nationkey) WITHIN GROUP (ORDER BY n_nationkey) FROM {nation}": "INVALID_SQL_SYNTAX.FUNCTION_WITH_UNSUPPORTED_SYNTAX",
    "SELECT percentile_cont(n_nationkey) WITHIN GROUP (ORDER BY n_nationkey) FROM {nation}": "DATATYPE_MISMATCH.NON_FOLDABLE_INPUT",
    "SELECT mode(n_nationkey) WITHIN GROUP (ORDER BY n_nationkey) FROM {nation}": "INVALID_WITHIN_GROUP_EXPRESSION.WRONG_NUM_ORDERINGS",
    "SELECT listagg(DISTINCT n_name, ',') WITHIN GROUP (ORDER BY n_regionkey) FROM {nation}": "INVALID_WITHIN_GROUP_EXPRESSION.MISMATCH_WITH_DISTINCT_INPUT",
    "SELECT row_number() FROM {nation}": "WINDOW_FUNCTION_WITHOUT_OVER_CLAUSE",
    "SELECT n_name FROM {nation} WHERE sum(n_nationkey) > 1": "INVALID_WHERE_CONDITION",
    "SELECT n_name FROM {nation} GROUP BY sum(n_nationkey)": "GROUP_BY_AGGREGATE",
    "SELECT n_nationkey FROM {nation} a, {nation} b": "AMBIGUOUS_REFERENCE",
    "INSERT INTO no_such_table VALUES (1)": "TABLE_OR_VIEW_NOT_FOUND",
    "SELECT * FROM no_such_table": "TABLE_OR_VIEW_NOT_FOUND",
    "SELECT no_such_function(1)": "UNRESOLVED_ROUTINE",
    "SELECT (SELECT n_nationkey FROM {nation})": "SCALAR_SUBQUERY_TOO_MANY_ROWS",
    "SELECT element_at(map('a', n_nationkey), 'b') IS NULL, raise_error(n_name) FROM {nation}": "USER_RAISED_EXCEPTION",
}


@C.frame("error_conditions", "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(_ERRORS.values())) + ") AS t(i, condition)")
def _(spark, d):
    rows = []
    for i, text in enumerate(_ERRORS):
        try:
            spark.sql(bind(text, d)).collect()  # fails before any row comes
            rows.append((i, "none"))
        except Exception as e:  # noqa: BLE001  some come as the JVM's own
            found = e.getCondition() if isinstance(e, PySparkException) else None
            rows.append((i, found or re.search(r"\[([A-Z_.]+)\]", str(e))[1]))
    return spark.createDataFrame(rows, "i int, condition string")


@C.frame("error_view_over_temp_view", "SELECT 'INVALID_TEMP_OBJ_REFERENCE' AS condition")
def _(spark, d):
    v = _name()
    table(spark, d, "nation").createOrReplaceTempView(v)
    try:
        spark.sql(f"CREATE VIEW {_name()} AS SELECT * FROM {v}")
        got = "none"
    except PySparkException as e:
        got = e.getCondition()
    return spark.createDataFrame([(got,)], "condition string")


# -- user-defined functions by name, artifacts ----------------------------------------------


@C.frame("udf_by_sql_name", "SELECT n_nationkey, 'N' || n_name[8:8] AS i FROM nation")
def _(spark, d):
    udfs.register(spark)
    return spark.sql(bind("SELECT n_nationkey, initials(n_name) AS i FROM {nation}", d))


@C.frame("udf_artifact", "SELECT n_nationkey, n_nationkey * 3 AS t FROM nation")
def _(spark, d):
    name = f"shipped_{uuid.uuid4().hex}"
    home = tempfile.mkdtemp(prefix="quarry-artifact-")  # on the driver, which serves the file to every executor
    with open(f"{home}/{name}.py", "w") as f:
        f.write("def triple(x):\n    return 3 * x\n")
    spark.sparkContext.addPyFile(f"{home}/{name}.py")

    def triple(batches):
        import importlib

        own = importlib.import_module(name)
        for b in batches:
            yield b.assign(t=own.triple(b["n_nationkey"]))[["n_nationkey", "t"]]

    return table(spark, d, "nation").select("n_nationkey").mapInPandas(triple, "n_nationkey int, t int")


@C.frame("fn_avro_round_trip", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS price, o_orderkey % 4 AS n, o_custkey AS last FROM orders")
def _(spark, d):
    from ..functions import avro

    o = table(spark, d, "orders").select(F.struct(
        "o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("price"), F.expr("array_repeat(o_custkey, CAST(o_orderkey % 4 AS INT))").alias("many"), F.create_map(F.lit("last"), "o_custkey").alias("m"),
    ).alias("row"))
    kind = o.schema["row"].dataType
    import json

    packed = o.select(avro.to_avro(F.col("row"), kind).alias("data"))
    back = packed.select(avro.from_avro(F.col("data"), json.dumps(avro.avro_schema(kind))).alias("r"))
    return back.select("r.o_orderkey", "r.o_orderstatus", "r.price", F.size("r.many").cast("long").alias("n"), F.col("r.m")["last"].alias("last"))


@C.frame("fn_avro_broken_records", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS name FROM nation")
def _(spark, d):
    from ..functions import avro

    n = table(spark, d, "nation").withColumn("data", avro.to_avro(F.col("n_name"), table(spark, d, "nation").schema["n_name"].dataType))
    cut = F.when(F.col("n_nationkey") % 2 == 0, F.col("data")).otherwise(F.substring("data", 1, 3))
    return n.select("n_nationkey", avro.from_avro(cut, '"string"', mode="PERMISSIVE").alias("name"))


# -- streaming ------------------------------------------------------------------------------


def _by_type(stream):
    return stream.groupBy("event_type").agg(F.count("*").alias("n"))


_TYPES = "SELECT event_type, count(*) AS n FROM events GROUP BY 1"


def _until_done(query):
    try:
        query.processAllAvailable()
    finally:
        query.stop()


@C.frame("stream_trigger_processing_time", _TYPES)
def _(spark, d):
    name = _name()
    _until_done(_by_type(S.file_stream(spark, d, "events")).writeStream.format("memory").queryName(name).outputMode("complete").trigger(processingTime="200 milliseconds").start())
    return spark.table(name)


@C.frame("stream_trigger_once", _TYPES)
def _(spark, d):
    name = _name()
    _by_type(S.file_stream(spark, d, "events")).writeStream.format("memory").queryName(name).outputMode("complete").trigger(once=True).start().awaitTermination()
    return spark.table(name)


@C.frame("stream_foreach_batch", _TYPES)
def _(spark, d):
    path = _folder(spark, "batches")
    S.run_each_batch(S.file_stream(spark, d, "events").select("event_type"), path, _folder(spark, "offsets"))
    return _by_type(spark.read.parquet(path))


@C.frame("stream_to_files_restart", "SELECT n_nationkey FROM nation")
def _(spark, d):
    source, out, offsets = _folder(spark, "spool"), _folder(spark, "sink"), _folder(spark, "offsets")
    n = table(spark, d, "nation").select("n_nationkey")
    for part in ("n_nationkey < 10", "n_nationkey >= 10"):  # the second run goes on where the first ended
        n.where(part).write.mode("append").json(source)
        S.run_to_files(S.spool_stream(spark, source, "n_nationkey int"), out, offsets)
    return spark.read.parquet(out)


@C.frame("stream_spool_source", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _(spark, d):
    source = _folder(spark, "spool")
    table(spark, d, "orders").select("o_orderkey", "o_orderstatus").write.json(source)
    out = S.spool_stream(spark, source, "o_orderkey long, o_orderstatus string").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    return S.run_stored(out, "complete")


@C.frame("stream_rate_source", "SELECT * FROM (VALUES ('timestamp', 'timestamp'), ('value', 'bigint')) AS t(name, kind)")
def _(spark, d):
    s = S.rate_stream(spark, 5)
    assert s.isStreaming
    return spark.createDataFrame(s.dtypes, "name string, kind string")


@C.frame("stream_query_manager", "SELECT * FROM (VALUES ('a', 'false'), ('b', 'false')) AS t(name, active)")
def _(spark, d):
    m, names = S.QueryManager(spark, _folder(spark, "manager")), {"a": _name(), "b": _name()}
    for own in names.values():
        m.start(own, S.file_stream(spark, d, "nation").select("n_nationkey"))
    for own in names.values():
        m.drain(own)
    m.await_all(30)
    rows = [(k, str(m.status(own)["active"]).lower()) for k, own in names.items()]
    for own in names.values():
        m.stop(own)
    return spark.createDataFrame(rows, "name string, active string")


@C.frame("stream_transform_with_state", "SELECT user_id, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
def _(spark, d):
    out = S.run_stored(S.latest_by_key(S.file_stream(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id"), "append")
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.max("last").alias("last"))


# -- lakehouse tables -----------------------------------------------------------------------

_ODD = "CASE n_regionkey WHEN 0 THEN 'a:b' WHEN 1 THEN NULL WHEN 2 THEN 'c d/e%' ELSE 'r' || n_regionkey END"


def _odd(spark, d):
    return table(spark, d, "nation").selectExpr("n_nationkey", "CASE n_regionkey WHEN 0 THEN 'a:b' WHEN 1 THEN NULL WHEN 2 THEN 'c d/e%' ELSE concat('r', n_regionkey) END AS p")


@C.frame("lake_delta_partition_values", f"SELECT n_nationkey, {_ODD} AS p FROM nation")
def _(spark, d):
    from ..sources import delta

    path = _folder(spark, "delta")
    delta.append_delta(_odd(spark, d), path, ["p"])
    return delta.read_delta(spark, path)


@C.frame("lake_delta_pruned", "SELECT n_nationkey, 'a:b' AS p FROM nation WHERE n_regionkey = 0")
def _(spark, d):
    from ..sources import delta

    path = _folder(spark, "delta")
    delta.append_delta(_odd(spark, d), path, ["p"])
    return delta.read_delta(spark, path, where="p = 'a:b'")


@C.frame("lake_delta_dml", """SELECT n_nationkey AS k, n_name || '!' AS v FROM nation WHERE n_nationkey BETWEEN 10 AND 14 UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey BETWEEN 15 AND 19
  UNION ALL SELECT n_nationkey, 'new' FROM nation WHERE n_nationkey BETWEEN 20 AND 22 UNION ALL SELECT 100, 'new'""")  # fmt: skip
def _(spark, d):
    from ..sources import delta

    path = _folder(spark, "delta")
    delta.append_delta(table(spark, d, "nation").selectExpr("n_nationkey AS k", "n_name AS v").repartition(3, "k"), path)
    delta.delete_delta(spark, path, "k < 10")
    delta.update_delta(spark, path, {"v": "concat(v, '!')"}, "k < 15")
    source = spark.createDataFrame([(20, "new"), (21, "new"), (22, "new"), (23, "gone"), (24, "gone"), (100, "new")], "k int, v string")
    delta.merge_delta(spark, path, source, ["k"], delete_when="v = 'gone'")
    return delta.read_delta(spark, path)


@C.frame("lake_delta_checkpoint", "SELECT 12 AS version, CAST(13 * count(*) AS BIGINT) AS n FROM region")
def _(spark, d):
    from ..sources import delta

    path, r = _folder(spark, "delta"), table(spark, d, "region").coalesce(1)
    for i in range(13):
        delta.append_delta(r, path)
        if i == 9:
            delta.checkpoint_delta(spark, path)
    return delta.read_delta(spark, path).agg(F.count("*").alias("n")).withColumn("version", F.lit(delta.snapshot(spark, path)[2]))


@C.frame("lake_delta_mapped_columns", "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation WHERE n_regionkey < 2")
def _(spark, d):
    from ..sources import delta

    path = _folder(spark, "delta")  # the files' names differ from the table's, as a renamed column leaves them
    rows = table(spark, d, "nation").selectExpr("n_nationkey AS `col-1`", "n_name AS `col-2`", "n_regionkey AS `col-3`")
    delta.append_delta(rows, path, ["col-3"], names={"col-1": "id", "col-2": "name", "col-3": "region"})
    return delta.read_delta(spark, path, where="region < 2")


@C.frame("lake_iceberg_partitioned", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 2 UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 2")
def _(spark, d):
    from ..sources import iceberg

    path, n = _folder(spark, "iceberg"), table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    for _ in range(2):
        iceberg.append_iceberg(n, path, ["n_regionkey"])
    return iceberg.read_iceberg(spark, path, where="n_regionkey = 2")


@C.frame("lake_iceberg_schema", "SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey, NULL FROM region")
def _(spark, d):
    from ..sources import iceberg

    path = _folder(spark, "iceberg")
    iceberg.append_iceberg(table(spark, d, "nation").select("n_nationkey", "n_name"), path)
    iceberg.append_iceberg(table(spark, d, "region").selectExpr("r_regionkey AS n_nationkey"), path)  # a file without a column
    return iceberg.read_iceberg(spark, path)


@C.frame("catalog_create_as", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def _(spark, d):
    from ..sources.catalogs import FolderCatalog, Registry

    reg = Registry(spark)
    reg.add("lake", FolderCatalog(spark, _folder(spark, "catalog")))
    reg.create_as("lake.geo.counts", table(spark, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n")))
    return reg.table("lake.geo.counts")


@C.frame("stats_of_a_run", "SELECT count(*) AS output_rows, true AS scanned, true AS timed FROM nation WHERE n_regionkey = 1")
def _(spark, d):
    from ..plans import inspect

    got = inspect.run_with_stats(table(spark, d, "nation").where("n_regionkey = 1"))
    return spark.createDataFrame([(got.output_rows, got.bytes_scanned > 0, got.duration_ms > 0)], "output_rows long, scanned boolean, timed boolean")


@C.frame("df_window_over_alias", "SELECT n_nationkey, sum(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::BIGINT AS s FROM nation")
def _(spark, d):
    w = Window.partitionBy("n.n_regionkey").orderBy("n.n_nationkey")
    return table(spark, d, "nation").alias("n").select("n.n_nationkey", F.sum("n.n_nationkey").over(w).alias("s"))
