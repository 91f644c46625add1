from __future__ import annotations

import re
from pathlib import Path

import pytest
from conftest import SF
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quarry.functions import dialect
from quarry.operators import joins
from quarry.plans import golden, inspect
from quarry.streaming import pipelines


def test_pushdown_and_pruning(spark):
    df = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_quantity > 40").select("l_orderkey")
    assert any("GreaterThan(l_quantity,40.0)" in x for x in inspect.pushed_filters(df))
    assert inspect.read_schemas(df) == ["struct<l_orderkey:bigint,l_quantity:double>"]
    assert inspect.exchanges(df) == 0


def test_query_stats(spark):
    got = inspect.run_with_stats(spark.read.parquet(f"{SF}/nation.parquet").where("n_regionkey = 1"))
    assert got.output_rows == 5 and got.bytes_scanned > 0 and got.duration_ms > 0


def test_dialect():
    assert dialect.rewrite("SELECT interval '90' day (3), 'day (3)'") == "SELECT interval '90' day, 'day (3)'"
    assert dialect.rewrite("SELECT to_timestamp_seconds(1) FROM json_scan('a.json')") == "SELECT timestamp_seconds(1) FROM json.`a.json`"
    assert dialect.split_statements("SELECT ';'; -- a;b\nSELECT 2;") == ["SELECT ';'", "-- a;b\nSELECT 2"]


@pytest.mark.parametrize(("text", "condition"), [
    ("SELECT 1 / 0", "DIVIDE_BY_ZERO"), ("SELECT 9223372036854775807 * 2", "ARITHMETIC_OVERFLOW"), ("SELECT CAST('x' AS INT)", "CAST_INVALID_INPUT"),
    ("SELECT nope", "UNRESOLVED_COLUMN.WITHOUT_SUGGESTION"), ("SELECT raise_error('x')", "USER_RAISED_EXCEPTION"), ("SELECT 1 IN (DATE '2020-01-01')", "DATATYPE_MISMATCH.DATA_DIFF_TYPES"),
    ("SELECT percentile_cont(0.5) FROM range(3)", None), ("SELECT 1 QUALIFY 1", "PARSE_SYNTAX_ERROR"),
])
def test_error_classes(spark, text, condition):
    with pytest.raises(PySparkException) as e:
        spark.sql(text).collect()
    assert condition is None or e.value.getCondition() == condition


def test_persistent_view_over_temp_view(spark):
    spark.range(1).createOrReplaceTempView("temp_only")
    with pytest.raises(PySparkException, match="INVALID_TEMP_OBJ_REFERENCE"):
        spark.sql("CREATE VIEW kept AS SELECT * FROM temp_only")


def test_commands(spark):
    spark.sql("CREATE TABLE IF NOT EXISTS cmd (a INT COMMENT 'x', b STRING) USING parquet TBLPROPERTIES ('k' = 'v')")
    spark.sql("INSERT OVERWRITE cmd VALUES (1, 'p'), (2, 'q')")
    spark.sql("ANALYZE TABLE cmd COMPUTE STATISTICS FOR ALL COLUMNS")
    assert spark.sql("SHOW TABLES LIKE 'cmd'").count() == 1 and spark.sql("SHOW COLUMNS IN cmd").count() == 2
    assert "CREATE TABLE" in spark.sql("SHOW CREATE TABLE cmd").first()[0]
    assert spark.sql("SHOW TBLPROPERTIES cmd ('k')").first()[1] == "v"
    for s in ("DESCRIBE TABLE EXTENDED cmd", "DESCRIBE QUERY SELECT 1 AS a", "DESCRIBE DATABASE default", "DESCRIBE FUNCTION abs", "DESCRIBE TABLE EXTENDED cmd AS JSON", "SHOW DATABASES", "SHOW CATALOGS", "SHOW VIEWS", "SHOW FUNCTIONS LIKE 'abs'", "SHOW TABLE EXTENDED LIKE 'cmd'", "EXPLAIN EXTENDED SELECT * FROM cmd"):
        assert spark.sql(s).count() >= 0
    spark.sql("ALTER TABLE cmd ADD COLUMNS (c INT)")
    spark.sql("CACHE TABLE cmd")
    assert spark.catalog.isCached("cmd") and spark.catalog.tableExists("cmd") and [c.name for c in spark.catalog.listColumns("cmd")] == ["a", "b", "c"]
    spark.sql("UNCACHE TABLE cmd")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW v AS SELECT a FROM cmd")
    spark.sql("CREATE OR REPLACE GLOBAL TEMPORARY VIEW gv AS SELECT 1 AS a")
    assert spark.table("global_temp.gv").count() == 1
    spark.sql("DROP VIEW v")
    spark.sql("DROP TABLE cmd")


def test_dataframe_shapes(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string")
    assert [r.k for r in df.orderBy("k").tail(1)] == [2]
    assert df.withColumn("k", F.col("k") + 1).columns == ["k", "s"]
    assert df.describe().count() == 5 and df.summary("mean").count() == 1 and df.crosstab("k", "s").count() == 2
    assert df.repartition(3, "k").rdd.getNumPartitions() == 3
    assert df.hint("broadcast").join(df, "k").count() == 2 and df.isLocal() is not None
    assert df.selectExpr("struct(k AS x, s AS y) AS st").select(F.col("st").withField("z", F.lit(1)).getField("z").alias("z")).first().z == 1
    assert df.select(df.colRegex("`(k|q)`")).columns == ["k"]
    assert df.where(df.k == spark.range(1).select(F.lit(2)).scalar()).count() == 1
    assert df.to(df.schema).count() == 2 and df.unionByName(df.drop("s"), allowMissingColumns=True).count() == 4


def test_checked_broadcast(spark):
    small, big = spark.range(10), spark.range(1000)
    assert "BroadcastHashJoin" in inspect.plan_text(joins.join_small(big, small, ["id"]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in inspect.plan_text(joins.join_small(big, small, ["id"], most=1))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_asof_edges(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), (None, 5), ("b", 3)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 5, 51), (None, 1, 9)], "k string, t int, v int")
    got = {(r.k, r.t): r.v for r in joins.asof_join(left, right, "k", "t", ["v"]).collect()}
    assert got == {("a", 5): 51, ("a", 1): None, (None, 5): None, ("b", 3): None}
    ahead = {(r.k, r.t): r.v for r in joins.asof_join(left, right, "k", "t", ["v"], direction="forward").collect()}
    assert ahead[("a", 1)] == 20 and ahead[("a", 5)] == 51


def test_golden(spark, tmp_path):
    blocks = golden.run_script(spark, "SELECT 1 AS a; SELECT 1/0; SELECT 0.1D + 0.2D AS x")
    golden.save(blocks, tmp_path / "g.json")
    counts = golden.compare(golden.run_script(spark, "SELECT 1 AS a; SELECT 1/0; SELECT 0.1D + 0.2D AS x"), tmp_path / "g.json")
    assert counts == {"blocks": 3, "strict": 3, "semantic": 3} and blocks[1].rows == ["DIVIDE_BY_ZERO"]
    golden.ratchet(counts, tmp_path / "r.json")
    with pytest.raises(AssertionError):
        golden.ratchet({"strict": 2}, tmp_path / "r.json")


def test_stream_manager_and_exactly_once(spark, tmp_path):
    m = pipelines.QueryManager(spark, str(tmp_path / "cp"))
    stream = pipelines.file_stream(spark, SF, "nation")
    assert stream.isStreaming
    q = m.start("nations", stream.select("n_nationkey"))
    q.awaitTermination()
    assert spark.table("nations").count() == 25 and m.status("nations")["active"] is False
    m.stop("nations")
    for _ in range(2):  # the checkpoint knows what has been written
        pipelines.run_to_files(stream, str(tmp_path / "out"), str(tmp_path / "cp2"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 25


def test_late_rows_are_dropped(spark, tmp_path):
    def batch(i, rows):
        spark.createDataFrame(rows, "ts string, v int").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "v").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))

    batch(1, [("2024-01-01 10:00:00", 1), ("2024-01-01 15:00:00", 1)])
    stream = spark.readStream.schema("ts TIMESTAMP, v INT").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = pipelines.tumbling(stream, "ts", "1 hour", [], "1 hour")
    run = lambda: out.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    run()
    batch(2, [("2024-01-01 10:30:00", 1), ("2024-01-01 18:00:00", 1)])  # the first is behind the watermark
    run()
    got = {str(r.start)[11:13]: r.n for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got == {"10": 1, "15": 1}


GOLDEN = Path(__file__).parent / "golden"


@pytest.mark.parametrize("name", sorted(p.stem for p in GOLDEN.glob("*.sql")))
def test_golden_scripts(spark, name):
    """Every statement of the recorded scripts, strictly; `python tests/test_engine.py` records them anew."""
    counts = golden.compare(golden.run_script(spark, (GOLDEN / f"{name}.sql").read_text()), GOLDEN / f"{name}.json")
    assert counts["strict"] == counts["blocks"] > 10, counts


#: The heaviest shapes, and the exchanges that each may have when nothing is broadcast.
WITHOUT_BROADCASTS = {"tpch_q03": 6, "tpch_q05": 11, "tpch_q09": 12, "tpch_q18": 8, "tpch_q21": 10, "join_star": 11, "ds_four_level_rollup": 9}


@pytest.mark.parametrize("name", WITHOUT_BROADCASTS)
def test_plans_without_broadcasts(spark, name):
    """With tables too large to broadcast: equi-joins by sort and merge only, filters and columns pushed to the scans, a bounded number of exchanges."""
    from quarry.queries import catalog

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = inspect.plan_text(catalog()[name].build(spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    joins = re.findall(r"^\(\d+\) (\w*Join\w*|CartesianProduct)", text, re.M)
    assert joins and not {"CartesianProduct", "BroadcastNestedLoopJoin", "BroadcastHashJoin"} & set(joins), joins
    assert len(re.findall(r"^\(\d+\) Exchange", text, re.M)) <= WITHOUT_BROADCASTS[name]
    wide = [s for s in inspect.read_schemas_of(text) if s.count(":") > 7]
    assert not wide, wide


def test_bench_runs_its_headlines():
    import bench
    from quarry.queries import catalog

    assert set(bench.HEADLINES) <= set(catalog())


if __name__ == "__main__":
    from quarry.session import get_spark

    session = get_spark("golden", "local[2]", spark__sql__shuffle__partitions="2")
    for script in GOLDEN.glob("*.sql"):
        golden.save(golden.run_script(session, script.read_text()), script.with_suffix(".json"))
