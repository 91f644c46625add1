from __future__ import annotations

import json
from pathlib import Path

import pytest
from conftest import SF
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.plans import inspect
from quarry.sources import catalogs, delta, files, iceberg, partitions


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json", "orc"])
def test_round_trip(spark, tmp_path, fmt):
    n = spark.read.parquet(f"{SF}/nation.parquet")
    path = str(tmp_path / fmt)
    files.write(n, fmt, path)
    again = files.read(spark, fmt, path, schema=n.schema)
    assert sorted(again.collect()) == sorted(n.collect())


def test_reads_all_paths_and_options(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"{i}.csv").write_text(f"a;b\n{i};x\n")
    df = files.read(spark, "csv", str(tmp_path / "1.csv"), str(tmp_path / "2.csv"), header="true", sep=";", inferSchema="true")
    assert sorted(map(tuple, df.collect())) == [(1, "x"), (2, "x")]
    with pytest.raises(ValueError):
        files.read(spark, "nope", "x")


def test_adapt(spark):
    df = spark.createDataFrame([(1, 5)], "ID int, when_ int")
    want = T.StructType([T.StructField("id", T.LongType()), T.StructField("when_", T.DateType()), T.StructField("extra", T.StringType())])
    row = files.adapt(df, want).first()
    assert (row.id, str(row.when_), row.extra) == (1, "1970-01-06", None)
    with pytest.raises(ValueError):
        files.adapt(df, T.StructType([T.StructField("must", T.LongType(), False)]))


def test_partition_pruning(spark, tmp_path):
    n, path = spark.read.parquet(f"{SF}/nation.parquet"), str(tmp_path / "p")
    files.write(n, "parquet", path, partition_by=["n_regionkey"])
    df = files.read_partitioned(spark, path, "n_regionkey = 2")
    assert df.count() == n.where("n_regionkey = 2").count()
    assert "PartitionFilters: [isnotnull(n_regionkey" in inspect.plan_text(df)
    paths = ["t/a=1/b=x/f", "t/a=2/b=y/f", "t/a=__HIVE_DEFAULT_PARTITION__/b=x/f"]
    assert partitions.prune_paths(paths, "a >= 2 AND b = 'y'") == paths[1:2]
    assert partitions.prune_paths(paths, "a in (1, 3)") == paths[:1]
    assert partitions.prune_paths(paths, "other = 3") == paths


def test_bucketed_join_has_no_exchange(spark):
    for i in (1, 2):
        files.write_bucketed(spark.range(1000).withColumn("v", F.col("id") * i), f"bucketed_{i}", ["id"], 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("bucketed_1").join(spark.table("bucketed_2"), "id")
        assert inspect.exchanges(joined) == 0 and joined.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_delta_log(spark, tmp_path):
    path = str(tmp_path / "d")
    n = spark.read.parquet(f"{SF}/nation.parquet")
    assert delta.append_delta(n, path, partition_by=["n_regionkey"]) == 0
    assert delta.append_delta(n.limit(3), path, partition_by=["n_regionkey"]) == 1
    assert delta.read_delta(spark, path).count() == 28
    assert delta.read_delta(spark, path, version=0).count() == 25
    assert delta.read_delta(spark, path, where="n_regionkey = 1").count() == delta.read_delta(spark, path).where("n_regionkey = 1").count()
    _, active, _ = delta.snapshot(spark, path)
    delta.remove_files(spark, path, [a["path"] for a in active])
    assert delta.read_delta(spark, path).count() == 0
    assert not delta._create(spark, f"{path}/_delta_log/{0:020d}.json", "x")
    log = Path(path) / "_delta_log" / f"{3:020d}.json"
    log.write_text(json.dumps({"add": {"path": "x.parquet", "partitionValues": {}, "size": 1, "modificationTime": 1, "dataChange": True, "deletionVector": {"storageType": "u"}}}))
    with pytest.raises(NotImplementedError):
        delta.read_delta(spark, path)
    assert delta.deletion_vectors(spark, path) == ["x.parquet"]


def test_iceberg_manifests(spark, tmp_path):
    path = str(tmp_path / "i")
    r = spark.read.parquet(f"{SF}/region.parquet")
    first = iceberg.append_iceberg(r, path)
    iceberg.append_iceberg(r, path)
    assert iceberg.read_iceberg(spark, path).count() == 10
    assert iceberg.read_iceberg(spark, path, snapshot_id=first).count() == 5


def test_catalogs(spark, tmp_path):
    reg = catalogs.Registry(spark)
    memory = catalogs.MemoryCatalog(str(tmp_path / "m"))
    memory.register("geo", "region", catalogs.TableInfo(f"{SF}/region.parquet"))
    reg.add("mem", memory)
    reg.add("dir", catalogs.FolderCatalog(spark, str(tmp_path / "f")))
    assert reg.sql("SELECT count(*) AS n FROM mem.geo.region").first().n == 5
    assert reg.create_as("mem.geo.copy", spark.range(3)).count() == 3
    assert reg.create_as("dir.a.b", spark.range(4)).count() == 4
    assert reg.table("dir.a.b").count() == 4
    reg.use("mem.geo")
    assert reg.table("region").count() == 5 and memory.list_tables("geo") == ["copy", "region"]
    assert reg.show_catalogs() == ["dir", "mem", "spark_catalog"]
    with pytest.raises(catalogs.TableNotFound):
        reg.table("mem.geo.none")
    fake = {"http://x/v1/namespaces": {"namespaces": [["a"]]}, "http://x/v1/namespaces/a/tables": {"identifiers": [{"name": "t"}]}, "http://x/v1/namespaces/a/tables/t": {"metadata": {"location": "/p"}}}
    rest = catalogs.RestCatalog("http://x/", fetch=fake.__getitem__)
    assert rest.table_exists("a", "t") and rest.load_table("a", "t").location == "/p"
    assert ("Catalog Name", "mem") in reg.describe_catalog("mem")


def test_s3_settings():
    from quarry.sources import stores

    got = stores.s3_settings("b", role_arn="arn:x", session_name="s", access_key="k", secret_key="v", region="eu-west-1")
    assert got["fs.s3a.bucket.b.assumed.role.arn"] == "arn:x" and got["fs.s3a.bucket.b.aws.credentials.provider"].endswith("AssumedRoleCredentialProvider")
    assert got["fs.s3a.bucket.b.assumed.role.credentials.provider"].endswith("SimpleAWSCredentialsProvider") and got["fs.s3a.bucket.b.endpoint.region"] == "eu-west-1"
    assert stores.s3_settings(endpoint="http://h:9", path_style=True) == {"fs.s3a.endpoint": "http://h:9", "fs.s3a.path.style.access": "true", "fs.s3a.aws.credentials.provider": "software.amazon.awssdk.auth.credentials.DefaultCredentialsProvider"}
    with pytest.raises(ValueError, match="both keys"):
        stores.s3_settings(access_key="k")
    assert [stores.table_url(u) for u in ("s3://b/x", "s3n://b/x", "/x")] == ["s3a://b/x", "s3a://b/x", "/x"]


def test_s3_settings_reach_the_file_system(spark):
    from quarry.sources import stores

    stores.configure_s3(spark, bucket="own", endpoint="http://h:9")
    assert spark.sparkContext._jsc.hadoopConfiguration().get("fs.s3a.bucket.own.endpoint") == "http://h:9"


class _Glue:
    """The calls of the public SDK's client that a catalog needs, over a dict; lists come in pages of one."""

    def __init__(self):
        self.tables = {}

    def get_databases(self, NextToken=None):  # noqa: N803
        names = sorted({d for d, _ in self.tables})
        i = int(NextToken or 0)
        return {"DatabaseList": [{"Name": n} for n in names[i : i + 1]], **({"NextToken": str(i + 1)} if i + 1 < len(names) else {})}

    def get_tables(self, DatabaseName, NextToken=None):  # noqa: N803
        names = sorted(t for d, t in self.tables if d == DatabaseName)
        i = int(NextToken or 0)
        return {"TableList": [{"Name": n} for n in names[i : i + 1]], **({"NextToken": str(i + 1)} if i + 1 < len(names) else {})}

    def get_table(self, DatabaseName, Name):  # noqa: N803
        if (DatabaseName, Name) not in self.tables:
            raise type("EntityNotFoundException", (Exception,), {})()
        return {"Table": self.tables[DatabaseName, Name]}

    def create_table(self, DatabaseName, TableInput):  # noqa: N803
        self.tables[DatabaseName, TableInput["Name"]] = TableInput


def test_glue_and_hive_catalogs(spark, tmp_path):
    from quarry.sources import catalogs

    client = _Glue()
    glue = catalogs.GlueCatalog(client, str(tmp_path))
    reg = catalogs.Registry(spark)
    reg.add("glue", glue)
    n = spark.read.parquet(f"{SF}/nation.parquet")
    for name in ("a", "b"):
        reg.create_as(f"glue.geo.{name}", n.select("n_nationkey", "n_name"))
    assert glue.list_namespaces() == ["geo"] and glue.list_tables("geo") == ["a", "b"] and glue.namespace_exists("geo")
    assert reg.sql("SELECT count(*) AS n FROM glue.geo.a JOIN glue.geo.b USING (n_nationkey)").first().n == 25
    assert not glue.table_exists("geo", "c")
    with pytest.raises(ValueError, match="exists"):
        reg.create_as("glue.geo.a", n)
    hive = catalogs.HiveCatalog(spark)
    reg.add("hive", hive)
    n.write.mode("overwrite").saveAsTable("hive_own")
    assert "default" in hive.list_namespaces() and "hive_own" in hive.list_tables("default")
    assert reg.table("hive.default.hive_own").count() == 25 and hive.load_table("default", "hive_own").format == "parquet"
    with pytest.raises(catalogs.TableNotFound):
        hive.load_table("default", "not_there")


def test_log_of_many_commits_is_read_in_few_jobs(spark, tmp_path):
    """1,000 commits: the last state is right, and the number of jobs does not grow with the log."""
    import json

    from quarry.sources import delta

    path = str(tmp_path / "t")
    delta.append_delta(spark.range(3).coalesce(1), path)
    name = delta.snapshot(spark, path)[1][0]["path"]
    add = {"path": name, "partitionValues": {}, "size": 1, "modificationTime": 1, "dataChange": True}
    for v in range(1, 1001):
        action = {"remove": {"path": name, "dataChange": True}} if v % 2 else {"add": add}
        (tmp_path / "t/_delta_log" / f"{v:020d}.json").write_text(json.dumps(action))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("many-commits", "")
    _, files, version = delta.snapshot(spark, path)
    jobs = len(tracker.getJobIdsForGroup("many-commits"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert version == 1000 and [f["path"] for f in files] == [name] and jobs <= 10
    assert delta.read_delta(spark, path).count() == 3 and delta.read_delta(spark, path, version=999).count() == 0


def test_foreign_log_with_partition_values_of_its_own(spark, tmp_path):
    """Files whose folders do not name the partitions, as other writers may lay them."""
    import json

    from quarry.sources import delta

    for i in range(2):
        spark.range(i, i + 1).coalesce(1).write.parquet(str(tmp_path / f"t/f{i}"))
    adds = []
    for i in range(2):
        leaf = next((tmp_path / f"t/f{i}").glob("*.parquet")).name
        adds.append({"add": {"path": f"f{i}/{leaf}", "partitionValues": {"day": None if i else "2024-01-02"}, "size": 1, "modificationTime": 1, "dataChange": True}})
    schema = spark.range(1).selectExpr("id", "DATE'2024-01-01' AS day").schema.json()
    (tmp_path / "t/_delta_log").mkdir()
    meta = {"metaData": {"id": "x", "format": {"provider": "parquet", "options": {}}, "schemaString": schema, "partitionColumns": ["day"], "configuration": {}, "createdTime": 1}}
    (tmp_path / "t/_delta_log" / f"{0:020d}.json").write_text("\n".join(map(json.dumps, [meta, *adds])))
    got = {r.id: str(r.day) for r in delta.read_delta(spark, str(tmp_path / "t")).collect()}
    assert got == {0: "2024-01-02", 1: "None"}


def test_conflicting_removal_and_double_merge_keys(spark, tmp_path):
    from quarry.sources import delta

    path = str(tmp_path / "t")
    delta.append_delta(spark.range(3).coalesce(1), path)
    name = delta.snapshot(spark, path)[1][0]["path"]
    delta.remove_files(spark, path, [name])
    with pytest.raises(RuntimeError, match="not in the table"):
        delta.remove_files(spark, path, [name])
    with pytest.raises(ValueError, match="more than once"):
        delta.merge_delta(spark, path, spark.range(1).unionAll(spark.range(1)), ["id"])
