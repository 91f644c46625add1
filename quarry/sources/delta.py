"""Tables with a JSON commit log: replay, time travel, append, delete, update, merge, checkpoints, pruning. Deletion vectors are refused."""

from __future__ import annotations

import functools
import json
import time
import uuid
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .partitions import matches, partition_values


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _log_files(spark: SparkSession, path: str) -> list[str]:
    fs, log = _fs(spark, f"{path}/_delta_log")
    if not fs.exists(log):
        raise FileNotFoundError(f"{path} has no commit log")
    return sorted(f.getPath().toString() for f in fs.listStatus(log))


def _version(name: str) -> int:
    return int(name.rsplit("/", 1)[1].split(".", 1)[0])


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> tuple[dict, list[dict], int]:
    """Metadata, active files and version. The last checkpoint at or before the version is read, then the commits after it.

    All log files are read together, and Spark keeps the last action of each data file; the driver gets
    the list of active files, as every file reader must. The number of jobs does not grow with the log.
    """
    names = [f for f in _log_files(spark, path) if f.endswith((".json", ".parquet")) and not f.endswith("_last_checkpoint")]
    names = [f for f in names if version is None or _version(f) <= version]
    marks = [f for f in names if f.endswith(".parquet")]
    last = max(map(_version, marks), default=-1)
    commits = [f for f in names if f.endswith(".json") and _version(f) > last]
    if not commits and last < 0:
        raise FileNotFoundError(f"{path} has no commits")
    number = F.element_at(F.split(F.input_file_name(), "/"), -1).substr(1, 20).cast("long").alias("version")
    parts = []
    if last >= 0:
        parts.append(spark.read.parquet(*[f for f in marks if _version(f) == last]).select(F.to_json(F.struct("*")).alias("value"), F.lit(last).cast("long").alias("version")))
    if commits:
        parts.append(spark.read.text(commits).select("value", number))
    rows = functools.reduce(DataFrame.unionAll, parts)
    got = {k: F.get_json_object("value", f"$.{k}") for k in ("add.path", "remove.path", "metaData.id")}
    rows = rows.withColumns({"added": got["add.path"], "file": F.coalesce(got["add.path"], got["remove.path"]), "meta": got["metaData.id"]})
    meta_row = rows.where("meta IS NOT NULL").agg(F.max_by("value", "version").alias("value")).first()
    meta = json.loads(meta_row.value)["metaData"] if meta_row.value else {}
    # of one commit's actions on a file the addition counts
    final = rows.where("file IS NOT NULL").groupBy("file").agg(F.max_by(F.struct("added", "value"), F.struct("version", F.col("added").isNotNull())).alias("a"))
    active = [json.loads(r.value)["add"] for r in final.where("a.added IS NOT NULL").orderBy("file").select("a.value").collect()]
    for add in active:
        if add.get("deletionVector"):
            raise NotImplementedError("the table has deletion vectors")
        add["partitionValues"] = {c: (add.get("partitionValues") or {}).get(p) for c, p in _physical(meta).items() if c in (meta.get("partitionColumns") or [])}
    return meta, active, max(map(_version, commits), default=last)


def _physical(meta: dict) -> dict[str, str]:
    """The files' name of each of the table's columns: another one where the table maps names."""
    mapped = (meta.get("configuration") or {}).get("delta.columnMapping.mode", "none") != "none"
    fields = json.loads(meta.get("schemaString") or '{"fields": []}')["fields"]
    return {f["name"]: f["metadata"].get("delta.columnMapping.physicalName", f["name"]) if mapped else f["name"] for f in fields}


def deletion_vectors(spark: SparkSession, path: str) -> list[str]:
    """Data files of the log that have a deletion vector."""
    rows = spark.read.json([f for f in _log_files(spark, path) if f.endswith(".json")])
    if "add" not in rows.columns or "deletionVector" not in rows.schema["add"].dataType.fieldNames():
        return []
    return [r.path for r in rows.where("add.deletionVector is not null").select("add.path").collect()]


def read_delta(spark: SparkSession, path: str, version: int | None = None, where: str | None = None) -> DataFrame:
    """The table at a version; `where` (a conjunction on partition columns) prunes files by the log's partition values."""
    meta, files, _ = snapshot(spark, path, version)
    schema = T.StructType.fromJson(json.loads(meta["schemaString"])) if meta.get("schemaString") else None
    parts = meta.get("partitionColumns") or []
    if where:
        files = [a for a in files if matches(a["partitionValues"], where)]
    if not files:
        return spark.createDataFrame([], schema or T.StructType())
    names = [unquote(a["path"]) for a in files]
    paths = [n if "://" in n else f"{path}/{n}" for n in names]
    if schema is None:
        df = spark.read.parquet(*paths)
        return df.where(where) if where else df
    own = _physical(meta)
    inside = T.StructType([T.StructField(own[f.name], f.dataType, f.nullable) for f in schema.fields])
    values = [{own[c]: v for c, v in a["partitionValues"].items()} for a in files]
    if not parts:
        df = spark.read.schema(inside).parquet(*paths)
    elif all(partition_values(n) == v for n, v in zip(names, values, strict=True)):
        df = spark.read.option("basePath", path).schema(inside).parquet(*paths)
    else:
        df = _with_values(spark, inside, [own[c] for c in parts], paths, values)
    df = df.select(*[F.col(f"`{own[f.name]}`").alias(f.name) for f in schema.fields])
    return df.where(where) if where else df


def _with_values(spark: SparkSession, schema: T.StructType, parts: list[str], paths: list[str], values: list[dict]) -> DataFrame:
    """Files whose folders do not tell the partition values: these come from the log, one short row for each file."""
    own = T.StructType([f for f in schema.fields if f.name not in parts])
    name = lambda c: F.regexp_replace(F.regexp_replace(c, "^([A-Za-z0-9]+):/+", "$1:/"), "^/+", "file:/")
    rows = [(str(_fs(spark, p)[0].makeQualified(spark._jvm.org.apache.hadoop.fs.Path(p)).toUri()), *(v[c] for c in parts)) for p, v in zip(paths, values, strict=True)]
    known = spark.createDataFrame(rows, T.StructType([T.StructField("_file", T.StringType()), *(T.StructField(c, T.StringType()) for c in parts)]))
    known = known.select(name(F.col("_file")).alias("_file"), *[F.col(f"`{c}`").cast(schema[c].dataType).alias(c) for c in parts])
    df = spark.read.option("recursiveFileLookup", "true").schema(own).parquet(*paths).withColumn("_file", name(F.col("_metadata.file_path")))
    return df.join(known, "_file").drop("_file")


def _stage(df: DataFrame, path: str, partition_by: list[str]) -> list[dict]:
    """Write df's files into the table's folder and return their additions, not yet committed."""
    spark = df.sparkSession
    tag = uuid.uuid4().hex
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/_staged-{tag}")
    fs, staged = _fs(spark, f"{path}/_staged-{tag}")
    adds, now = [], int(time.time() * 1000)
    walk = fs.listFiles(staged, True)
    while walk.hasNext():
        f = walk.next()
        name = f.getPath().toString().split(f"_staged-{tag}/", 1)[1]
        if not name.endswith(".parquet"):
            continue
        folder, _, leaf = name.rpartition("/")
        target = f"{folder + '/' if folder else ''}{tag[:8]}-{leaf}"
        _, to = _fs(spark, f"{path}/{target}")
        fs.mkdirs(to.getParent())
        fs.rename(f.getPath(), to)
        # the log holds the values themselves, null for the default folder, and paths as URLs
        adds.append({"add": {"path": quote(target, safe="/="), "partitionValues": partition_values(name), "size": f.getLen(), "modificationTime": now, "dataChange": True}})
    fs.delete(staged, True)
    return adds


def append_delta(df: DataFrame, path: str, partition_by: list[str] | None = None, retries: int = 10, names: dict[str, str] | None = None) -> int:
    """Write df's files and commit them as the next version; another writer's commit means a retry with the version after it.

    names: for a new table, its name of each column of the files (column mapping by name).
    """
    spark, now = df.sparkSession, int(time.time() * 1000)
    adds = _stage(df, path, partition_by or [])
    try:
        _, _, version = snapshot(spark, path)
        head: list[dict] = []
    except FileNotFoundError:
        version = -1
        head = [
            {"protocol": {"minReaderVersion": 2, "minWriterVersion": 5} if names else {"minReaderVersion": 1, "minWriterVersion": 2}},
            {"metaData": {"id": str(uuid.uuid4()), "format": {"provider": "parquet", "options": {}}, "schemaString": _mapped(df.schema, names or {}).json(), "partitionColumns": [(names or {}).get(c, c) for c in partition_by or []], "configuration": {"delta.columnMapping.mode": "name"} if names else {}, "createdTime": now}},
        ]
    for _ in range(retries):
        version += 1
        body = "\n".join(map(json.dumps, [{"commitInfo": {"timestamp": now, "operation": "WRITE"}}, *(head if version == 0 else []), *adds]))
        if _create(spark, f"{path}/_delta_log/{version:020d}.json", body):
            return version
    raise RuntimeError("other writers kept committing first")


def _mapped(schema: T.StructType, names: dict[str, str]) -> T.StructType:
    if not names:
        return schema
    return T.StructType([T.StructField(names[f.name], f.dataType, f.nullable, {"delta.columnMapping.id": i, "delta.columnMapping.physicalName": f.name}) for i, f in enumerate(schema.fields, 1)])


def remove_files(spark: SparkSession, path: str, names: list[str], retries: int = 10) -> int:
    """Commit the removal of active data files, by their paths in the log; a file that another writer removed first is an error."""
    return _commit_dml(spark, path, names, [], "DELETE", retries)


def _commit_dml(spark: SparkSession, path: str, removed: list[str], adds: list[dict], operation: str, retries: int = 10) -> int:
    now = int(time.time() * 1000)
    for _ in range(retries):
        _, active, version = snapshot(spark, path)
        gone = set(removed) - {a["path"] for a in active}
        if gone:
            raise RuntimeError(f"files that are not in the table any more: {sorted(gone)[:3]}")
        actions = [{"commitInfo": {"timestamp": now, "operation": operation}}, *({"remove": {"path": n, "deletionTimestamp": now, "dataChange": True}} for n in removed), *adds]
        if _create(spark, f"{path}/_delta_log/{version + 1:020d}.json", "\n".join(map(json.dumps, actions))):
            return version + 1
    raise RuntimeError("other writers kept committing first")


def _rewrite(spark: SparkSession, path: str, changed: DataFrame, touched: list[str], operation: str) -> int:
    """Replace the files touched by those of a frame, in one commit."""
    meta, _, _ = snapshot(spark, path)
    own = _physical(meta)
    return _commit_dml(spark, path, touched, _stage(changed.withColumnsRenamed(own), path, [own[c] for c in meta.get("partitionColumns") or []]), operation)


def _touched(spark: SparkSession, path: str, df: DataFrame) -> list[str]:
    """Log paths of the active files that rows of df (which has `_file`) lie in: one name for each file."""
    _, files, _ = snapshot(spark, path)
    leaf = {unquote(a["path"]).rsplit("/", 1)[-1]: a["path"] for a in files}
    return [leaf[r._file] for r in df.select("_file").distinct().collect()]


def _rows(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows with the name of their file."""
    return read_delta(spark, path).select("*", F.element_at(F.split(F.input_file_name(), "/"), -1).alias("_file"))


def delete_delta(spark: SparkSession, path: str, where: str) -> int:
    """Delete the rows a condition holds for: the files that hold any are written anew without them."""
    rows = _rows(spark, path)
    touched = _touched(spark, path, rows.where(where))
    if not touched:
        return snapshot(spark, path)[2]
    names = [unquote(t).rsplit("/", 1)[-1] for t in touched]
    return _rewrite(spark, path, rows.where(F.col("_file").isin(names)).where(f"NOT coalesce({where}, false)").drop("_file"), touched, "DELETE")


def update_delta(spark: SparkSession, path: str, changes: dict[str, str], where: str) -> int:
    """Set columns to SQL expressions in the rows a condition holds for."""
    rows = _rows(spark, path)
    touched = _touched(spark, path, rows.where(where))
    if not touched:
        return snapshot(spark, path)[2]
    names = [unquote(t).rsplit("/", 1)[-1] for t in touched]
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    hit = F.coalesce(F.expr(where), F.lit(False))
    new = {c: F.when(hit, F.expr(e).cast(kinds[c])).otherwise(F.col(c)) for c, e in changes.items()}
    return _rewrite(spark, path, rows.where(F.col("_file").isin(names)).withColumns(new).drop("_file"), touched, "UPDATE")


def merge_delta(spark: SparkSession, path: str, source: DataFrame, on: list[str], delete_when: str | None = None) -> int:
    """Upsert by key: rows of the table that the source has are replaced (or, where `delete_when` holds on the source's row, deleted), the source's others are added.

    source has the table's columns and no key twice; only files with a key of the source are written anew.
    """
    if source.groupBy(*on).count().where("count > 1").limit(1).count():
        raise ValueError("a key is in the source more than once")
    rows = _rows(spark, path)
    columns = [c for c in rows.columns if c != "_file"]
    touched = _touched(spark, path, rows.join(source.select(*on), on, "left_semi"))
    names = [unquote(t).rsplit("/", 1)[-1] for t in touched]
    kept = rows.where(F.col("_file").isin(names)).drop("_file").join(source.select(*on), on, "left_anti").select(*columns)
    fresh = source.where(f"NOT coalesce({delete_when}, false)") if delete_when else source
    return _rewrite(spark, path, kept.unionAll(fresh.select(*columns)), touched, "MERGE")


def checkpoint_delta(spark: SparkSession, path: str) -> int:
    """Write the state of the latest version as one Parquet file, which later reads begin from."""
    meta, files, version = snapshot(spark, path)
    body = [json.dumps({"metaData": meta}), *(json.dumps({"add": a}) for a in files)]
    schema = (
        "metaData struct<id:string,format:struct<provider:string,options:map<string,string>>,schemaString:string,partitionColumns:array<string>,configuration:map<string,string>,createdTime:long>,"
        " add struct<path:string,partitionValues:map<string,string>,size:long,modificationTime:long,dataChange:boolean>"
    )
    rows = spark.createDataFrame([(b,) for b in body], "value string").select(F.from_json("value", schema).alias("a")).select("a.*")
    tag = f"{path}/_delta_log/_staged-{uuid.uuid4().hex}"
    rows.coalesce(1).write.parquet(tag)
    fs, staged = _fs(spark, tag)
    part = next(f.getPath() for f in fs.listStatus(staged) if f.getPath().getName().endswith(".parquet"))
    fs.rename(part, _fs(spark, f"{path}/_delta_log/{version:020d}.checkpoint.parquet")[1])
    fs.delete(staged, True)
    return version


def _create(spark: SparkSession, path: str, body: str) -> bool:
    """Create a file that must not exist; False if it does."""
    fs, p = _fs(spark, path)
    try:
        out = fs.create(p, False)
    except Exception as e:  # noqa: BLE001  Py4J wraps the file system's own exception
        if "exist" in str(e).lower():
            return False
        raise
    out.write(bytearray(body.encode()))
    out.close()
    return True
