"""Streams, user-defined functions, lakehouse tables, commands and session features as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import dialect, udfs
from ..session import shared_folder
from ..streaming import pipelines as S
from .registry import Catalog, bind, table

C = Catalog()
_DAY = "date_trunc('day', ts)"


@C.frame("stream_tumbling_complete", f"SELECT strftime({_DAY}, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    out = S.run_to_memory(S.tumbling(S.file_stream(spark, d, "events", "ts"), "ts", "1 day", ["event_type"]), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@C.frame("stream_tumbling_append", f"SELECT strftime({_DAY}, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, {_DAY} HAVING {_DAY} + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def _(spark, d):  # windows that the watermark has not passed stay open
    out = S.run_stored(S.tumbling(S.file_stream(spark, d, "events", "ts"), "ts", "1 day", []))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n")


@C.frame("stream_sliding", "SELECT strftime(w, '%Y-%m-%d %H') AS start, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts) + INTERVAL 12 HOUR * (hour(ts) // 12), date_trunc('day', ts) + INTERVAL 12 HOUR * (hour(ts) // 12 - 1)]) AS w FROM events) GROUP BY 1")
def _(spark, d):
    out = S.run_stored(S.sliding(S.file_stream(spark, d, "events", "ts"), "ts", "1 day", "12 hours", []), "complete")
    return out.select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "n")


@C.frame("stream_session", """SELECT user_id, n, count(*) AS sessions FROM (SELECT user_id, s, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM
  (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY 1, 2) GROUP BY 1, 2""")  # fmt: skip
def _(spark, d):
    out = S.run_stored(S.sessions(S.file_stream(spark, d, "events", "ts"), "ts", "6 hours", "user_id"), "complete")
    return out.groupBy("user_id", "n").agg(F.count("*").alias("sessions"))


@C.frame("stream_dedup", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1, 2")
def _(spark, d):
    out = S.run_stored(S.deduplicated(S.file_stream(spark, d, "events").select("user_id", "event_type"), ["user_id", "event_type"]))
    return out.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@C.frame("stream_dedup_watermark", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1, 2")
def _(spark, d):  # all events of a type and user lie within the 60 days, so one of each is left
    out = S.run_stored(S.deduplicated(S.file_stream(spark, d, "events", "ts"), ["user_id", "event_type"], "ts", "60 days"))
    return out.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@C.frame("stream_static_join", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def _(spark, d):
    joined = S.file_stream(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return S.run_stored(joined.groupBy("n_name").agg(F.count("*").alias("n")), "complete")


@C.frame("stream_stream_join", "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 2 HOUR WHERE a.event_type = 'purchase' AND b.event_type = 'view'")
def _(spark, d):
    e = S.file_stream(spark, d, "events", "ts")
    joined = S.interval_join(e.where("event_type = 'purchase'"), S.file_stream(spark, d, "events", "ts").where("event_type = 'view'"), "user_id", "ts", "ts", "2 HOURS")
    return S.run_stored(joined.selectExpr("l.event_id AS a", "r.event_id AS b"))


@C.frame("stream_custom_state", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def _(spark, d):
    out = S.run_stored(S.running_totals(S.file_stream(spark, d, "events"), "user_id", "value"), "update")
    return out.groupBy("user_id").agg(F.max("n").alias("n"), F.max_by(F.round("total", 4), "n").alias("total"))


@C.frame("udf_python", "SELECT n_nationkey, 'N' || n_name[8:8] AS i FROM nation")
def _(spark, d):
    return table(spark, d, "nation").select("n_nationkey", udfs.initials("n_name").alias("i"))


@C.frame("udf_pandas", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS p FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(udfs.discounted("l_extendedprice", "l_discount"), 4).alias("p"))


@C.frame("udf_arrow", "SELECT n_nationkey, CAST(n_nationkey * n_nationkey AS BIGINT) AS s FROM nation")
def _(spark, d):
    return table(spark, d, "nation").select("n_nationkey", udfs.squared("n_nationkey").alias("s"))


@C.frame("udf_grouped_aggregate", "SELECT p_brand, round(exp(avg(ln(p_retailprice))), 4) AS g FROM part GROUP BY p_brand")
def _(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.round(udfs.geometric_mean("p_retailprice"), 4).alias("g"))


@C.frame("udf_map_in_pandas", "SELECT n_nationkey, n_regionkey, n_regionkey / 2 AS half FROM nation")
def _(spark, d):
    return table(spark, d, "nation").select("n_nationkey", "n_regionkey").mapInPandas(udfs.centred, "n_nationkey int, n_regionkey int, half double")


@C.frame("udf_apply_in_pandas", "SELECT n_nationkey, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS place FROM nation")
def _(spark, d):
    return udfs.grouped_ranks(table(spark, d, "nation").select("n_nationkey", "n_regionkey"), "n_regionkey", "n_nationkey")


@C.frame("udf_cogroup", "SELECT r_regionkey AS k, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def _(spark, d):
    import pandas as pd

    def count(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [key[0]], "n": [len(right)]})

    return table(spark, d, "region").groupBy("r_regionkey").cogroup(table(spark, d, "nation").groupBy("n_regionkey")).applyInPandas(count, "k int, n long")


@C.frame("udf_table_function", "SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part")
def _(spark, d):
    udfs.register(spark)
    return spark.sql(bind("SELECT p_partkey, w.word FROM {part}, LATERAL split_words(p_type) w", d))


@C.frame("udf_table_partition_by", "SELECT n_regionkey AS key, count(*) AS rows, CAST(sum(n_nationkey) AS DOUBLE) AS total FROM nation GROUP BY 1")
def _(spark, d):
    udfs.register(spark)
    return spark.sql(bind("SELECT * FROM sum_partition(TABLE(SELECT n_regionkey, n_nationkey FROM {nation}) PARTITION BY n_regionkey)", d))


@C.frame("udf_sql", "SELECT p_partkey, round(p_retailprice * 1.1, 4) AS a, round(p_retailprice * 1.2, 4) AS b FROM part")
def _(spark, d):
    udfs.register(spark)
    return spark.sql(bind("SELECT p_partkey, round(add_tax(p_retailprice), 4) AS a, round(add_tax(p_retailprice, 0.2), 4) AS b FROM {part}", d))


@C.frame("udf_sql_table", "SELECT r_regionkey, unnest(range(1, r_regionkey + 2))::INTEGER AS i FROM region")
def _(spark, d):
    udfs.register(spark)
    return spark.sql(bind("SELECT r_regionkey, t.i FROM {region}, LATERAL numbers_to(r_regionkey + 1) t", d))


@C.frame("sql_dialect", "SELECT n_nationkey, strftime(to_timestamp(n_nationkey) AT TIME ZONE 'UTC', '%H:%M:%S') AS t FROM nation")
def _(spark, d):
    return dialect.sql(spark, f"SELECT n_nationkey, date_format(to_timestamp_seconds(n_nationkey), 'HH:mm:ss') AS t FROM parquet_scan('{d}/nation.parquet') WHERE interval '90' day (3) > interval '1' day")


@C.frame("sql_parameters", "SELECT n_name FROM nation WHERE n_regionkey = 2 AND n_nationkey > 3")
def _(spark, d):
    return spark.sql(bind("SELECT n_name FROM {nation} WHERE n_regionkey = :region AND n_nationkey > :least", d), args={"region": 2, "least": 3})


@C.frame("sql_identifier_clause", "SELECT n_name, n_nationkey FROM nation")
def _(spark, d):
    table(spark, d, "nation").createOrReplaceTempView("nation_view")
    return spark.sql("SELECT IDENTIFIER(:c), n_nationkey FROM IDENTIFIER(:t)", args={"c": "n_name", "t": "nation_view"})


@C.frame("sql_variables", "SELECT n_name, 3 AS wanted FROM nation WHERE n_regionkey = 3")
def _(spark, d):
    name = f"wanted_{uuid.uuid4().hex}"  # read when the plan runs, so each frame has a variable of its own
    spark.sql(f"DECLARE VARIABLE {name} INT DEFAULT 1")
    spark.sql(f"SET VAR {name} = (SELECT 2 + 1)")
    return spark.sql(bind(f"SELECT n_name, {name} AS wanted FROM {{nation}} WHERE n_regionkey = {name}", d))


@C.frame("sql_execute_immediate", "SELECT count(*) AS n FROM nation WHERE n_regionkey > 1")
def _(spark, d):
    return spark.sql(bind("EXECUTE IMMEDIATE 'SELECT count(*) AS n FROM {nation} WHERE n_regionkey > ?' USING 1", d))


@C.frame("sql_transform_script", "SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name AS v FROM nation")
def _(spark, d):
    return spark.sql(bind("SELECT TRANSFORM(n_nationkey, n_name) USING 'cat' AS (k STRING, v STRING) FROM {nation}", d))


@C.frame("ddl_ctas_insert", "SELECT n_regionkey, count(*) + 1 AS n FROM nation GROUP BY 1")
def _(spark, d):
    name = f"t_{uuid.uuid4().hex}"
    spark.sql(bind(f"CREATE TABLE {name} USING parquet AS SELECT n_nationkey, n_regionkey FROM {{nation}}", d))
    spark.sql(bind(f"INSERT INTO {name} SELECT r_regionkey, r_regionkey FROM {{region}}", d))
    return spark.table(name).groupBy("n_regionkey").agg(F.count("*").alias("n"))


@C.frame("ddl_partitioned_overwrite", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey IN (1, 2) AND n_nationkey > 5 OR n_regionkey = 3")
def _(spark, d):
    name = f"t_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (n_nationkey INT, n_name STRING, n_regionkey INT) USING parquet PARTITIONED BY (n_regionkey)")
    spark.sql(bind(f"INSERT INTO {name} SELECT n_nationkey, n_name, n_regionkey FROM {{nation}} WHERE n_regionkey IN (1, 2, 3)", d))
    for r in (1, 2):  # one partition at a time; the third stays
        spark.sql(bind(f"INSERT OVERWRITE {name} PARTITION (n_regionkey = {r}) SELECT n_nationkey, n_name FROM {{nation}} WHERE n_regionkey = {r} AND n_nationkey > 5", d))
    return spark.table(name)


def _shared(spark, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


@C.frame("lake_delta_append_remove", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 0 UNION ALL SELECT r_regionkey, r_name FROM region")
def _(spark, d):
    from ..sources import delta

    path = _shared(spark, "delta")
    n = table(spark, d, "nation")
    delta.append_delta(n.where("n_regionkey = 0").select("n_nationkey", "n_name").coalesce(1), path)
    _, first, _ = delta.snapshot(spark, path)
    delta.append_delta(n.where("n_regionkey <> 0").select("n_nationkey", "n_name"), path)
    delta.append_delta(table(spark, d, "region").selectExpr("r_regionkey AS n_nationkey", "r_name AS n_name"), path)
    delta.remove_files(spark, path, [a["path"] for a in first])
    return delta.read_delta(spark, path)


@C.frame("lake_delta_time_travel", "SELECT count(*) AS n FROM region")
def _(spark, d):
    from ..sources import delta

    path, r = _shared(spark, "delta"), table(spark, d, "region")
    delta.append_delta(r, path)
    delta.append_delta(r, path)
    return delta.read_delta(spark, path, version=0).agg(F.count("*").alias("n"))


@C.frame("lake_iceberg_append", "SELECT n_regionkey, count(*) * 2 AS n FROM nation GROUP BY 1")
def _(spark, d):
    from ..sources import iceberg

    path, n = _shared(spark, "iceberg"), table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    iceberg.append_iceberg(n, path)
    iceberg.append_iceberg(n, path)
    return iceberg.read_iceberg(spark, path).groupBy("n_regionkey").agg(F.count("*").alias("n"))


@C.frame("catalog_registry", "SELECT count(*) AS n FROM nation WHERE n_regionkey = 1")
def _(spark, d):
    from ..sources.catalogs import MemoryCatalog, Registry, TableInfo

    own = MemoryCatalog()
    own.register("geo", "nation", TableInfo(f"{d}/nation.parquet"))
    reg = Registry(spark)
    reg.add("lake", own)
    return reg.sql("SELECT count(*) AS n FROM lake.geo.nation WHERE n_regionkey = 1")
