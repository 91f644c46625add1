"""Pluggable catalogs: a provider protocol, a registry with lazy tables, and providers for memory, folders and REST."""

from __future__ import annotations

import fnmatch
import json
import re
import urllib.request
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from . import files
from .delta import read_delta
from .iceberg import read_iceberg


@dataclass(frozen=True)
class TableInfo:
    """Where a table is and how it is read."""

    location: str
    format: str = "parquet"
    schema: T.StructType | None = None
    options: dict[str, str] = field(default_factory=dict)
    properties: dict[str, str] = field(default_factory=dict)


class CatalogProvider(Protocol):
    def list_namespaces(self) -> list[str]: ...
    def list_tables(self, namespace: str) -> list[str]: ...
    def load_table(self, namespace: str, table: str) -> TableInfo: ...
    def table_exists(self, namespace: str, table: str) -> bool: ...
    def namespace_exists(self, namespace: str) -> bool: ...
    def create_table(self, namespace: str, table: str, schema: T.StructType, fmt: str) -> TableInfo: ...


class TableNotFound(LookupError):
    pass


class MemoryCatalog:
    """Tables kept in a dict; new tables go below a folder."""

    def __init__(self, base: str | None = None):
        self.base, self.tables = base, {}

    def list_namespaces(self) -> list[str]:
        return sorted({n for n, _ in self.tables} | {"default"})

    def list_tables(self, namespace: str) -> list[str]:
        return sorted(t for n, t in self.tables if n == namespace)

    def load_table(self, namespace: str, table: str) -> TableInfo:
        try:
            return self.tables[namespace, table]
        except KeyError:
            raise TableNotFound(f"{namespace}.{table}") from None

    def table_exists(self, namespace: str, table: str) -> bool:
        return (namespace, table) in self.tables

    def namespace_exists(self, namespace: str) -> bool:
        return namespace in self.list_namespaces()

    def register(self, namespace: str, table: str, info: TableInfo) -> None:
        self.tables[namespace, table] = info

    def create_table(self, namespace: str, table: str, schema: T.StructType, fmt: str = "parquet") -> TableInfo:
        if self.base is None:
            raise ValueError("this catalog has no folder for new tables")
        info = TableInfo(f"{self.base}/{namespace}/{table}", fmt, schema)
        self.register(namespace, table, info)
        return info


class FolderCatalog:
    """A folder of namespaces of tables; a table's format shows in its files."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    def _names(self, path: str) -> list[str]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []

    def list_namespaces(self) -> list[str]:
        return [n for n in self._names(self.base) if not n.startswith((".", "_"))]

    def list_tables(self, namespace: str) -> list[str]:
        return [n.removesuffix(".parquet") for n in self._names(f"{self.base}/{namespace}") if not n.startswith((".", "_"))]

    def load_table(self, namespace: str, table: str) -> TableInfo:
        folder = f"{self.base}/{namespace}"
        names = self._names(folder)
        name = table if table in names else f"{table}.parquet"
        if name not in names:
            raise TableNotFound(f"{namespace}.{table}")
        inside = self._names(f"{folder}/{name}")
        if "_delta_log" in inside:
            fmt = "delta"
        elif "metadata" in inside:
            fmt = "iceberg"
        else:
            fmt = next((f for f in ("csv", "json", "orc") if any(x.endswith("." + f) for x in inside)), "parquet")
        return TableInfo(f"{folder}/{name}", fmt)

    def table_exists(self, namespace: str, table: str) -> bool:
        return table in self.list_tables(namespace)

    def namespace_exists(self, namespace: str) -> bool:
        return namespace in self.list_namespaces()

    def create_table(self, namespace: str, table: str, schema: T.StructType, fmt: str = "parquet") -> TableInfo:
        if self.table_exists(namespace, table):
            raise ValueError(f"{namespace}.{table} exists")
        return TableInfo(f"{self.base}/{namespace}/{table}", fmt, schema)


class RestCatalog:
    """A read-only client of REST catalogs with /v1/namespaces paths. fetch: url -> parsed JSON, replaceable in tests."""

    def __init__(self, uri: str, fetch=None, token: str | None = None):
        self.uri, self.token = uri.rstrip("/"), token
        self.fetch = fetch or self._get

    def _get(self, url: str) -> dict:
        head = {"Authorization": f"Bearer {self.token}"} if self.token else {}
        with urllib.request.urlopen(urllib.request.Request(url, headers=head), timeout=30) as r:  # noqa: S310
            return json.load(r)

    def list_namespaces(self) -> list[str]:
        return [".".join(n) for n in self.fetch(f"{self.uri}/v1/namespaces")["namespaces"]]

    def list_tables(self, namespace: str) -> list[str]:
        return [i["name"] for i in self.fetch(f"{self.uri}/v1/namespaces/{namespace}/tables")["identifiers"]]

    def load_table(self, namespace: str, table: str) -> TableInfo:
        try:
            meta = self.fetch(f"{self.uri}/v1/namespaces/{namespace}/tables/{table}")
        except OSError as e:
            raise TableNotFound(f"{namespace}.{table}") from e
        return TableInfo(meta["metadata"]["location"], "iceberg", properties=meta.get("config", {}))

    def table_exists(self, namespace: str, table: str) -> bool:
        return table in self.list_tables(namespace)

    def namespace_exists(self, namespace: str) -> bool:
        return namespace in self.list_namespaces()

    def create_table(self, namespace: str, table: str, schema: T.StructType, fmt: str) -> TableInfo:
        raise NotImplementedError("this catalog is read-only")


class HiveCatalog:
    """The session's own catalog, which is the Hive metastore in a session with Hive support; by namespaces and tables."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def list_namespaces(self) -> list[str]:
        return sorted(d.name for d in self.spark.catalog.listDatabases())

    def list_tables(self, namespace: str) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(namespace) if not t.isTemporary)

    def load_table(self, namespace: str, table: str) -> TableInfo:
        if not self.table_exists(namespace, table):
            raise TableNotFound(f"{namespace}.{table}")
        rows = {r.col_name: r.data_type for r in self.spark.sql(f"DESCRIBE EXTENDED `{namespace}`.`{table}`").collect()}
        return TableInfo(rows["Location"], (rows.get("Provider") or "parquet").lower(), schema=self.spark.table(f"`{namespace}`.`{table}`").schema)

    def table_exists(self, namespace: str, table: str) -> bool:
        return self.spark.catalog.tableExists(f"`{namespace}`.`{table}`")

    def namespace_exists(self, namespace: str) -> bool:
        return self.spark.catalog.databaseExists(namespace)

    def create_table(self, namespace: str, table: str, schema: T.StructType, fmt: str = "parquet") -> TableInfo:
        self.spark.createDataFrame([], schema).write.format(fmt).saveAsTable(f"`{namespace}`.`{table}`")
        return self.load_table(namespace, table)


class GlueCatalog:
    """A catalog behind the Glue API. client: an object with get_databases, get_tables, get_table and create_table, as the public SDK's client has them."""

    #: The serialisation classes by which tables name their formats.
    FORMATS = {"parquet": "parquet", "orc": "orc", "json": "json", "opencsv": "csv", "lazysimple": "csv"}

    def __init__(self, client, base: str | None = None):
        self.client, self.base = client, base

    def _pages(self, call, field: str, **args) -> list[dict]:
        out, token = [], None
        while True:
            got = call(**args, **({"NextToken": token} if token else {}))
            out += got[field]
            token = got.get("NextToken")
            if not token:
                return out

    def list_namespaces(self) -> list[str]:
        return sorted(d["Name"] for d in self._pages(self.client.get_databases, "DatabaseList"))

    def list_tables(self, namespace: str) -> list[str]:
        return sorted(t["Name"] for t in self._pages(self.client.get_tables, "TableList", DatabaseName=namespace))

    def load_table(self, namespace: str, table: str) -> TableInfo:
        try:
            t = self.client.get_table(DatabaseName=namespace, Name=table)["Table"]
        except Exception as e:
            if type(e).__name__ == "EntityNotFoundException":
                raise TableNotFound(f"{namespace}.{table}") from e
            raise
        where, kind = t["StorageDescriptor"], t.get("Parameters", {})
        if kind.get("table_type", "").upper() == "ICEBERG":
            return TableInfo(where["Location"], "iceberg")
        if kind.get("spark.sql.sources.provider") == "delta":
            return TableInfo(where["Location"], "delta")
        serde = where.get("SerdeInfo", {}).get("SerializationLibrary", "").lower()
        fmt = next((f for part, f in self.FORMATS.items() if part in serde), "parquet")
        cols = ", ".join(f"`{c['Name']}` {c['Type']}" for c in [*where["Columns"], *t.get("PartitionKeys", [])])
        return TableInfo(where["Location"], fmt, schema=T._parse_datatype_string(cols) if cols else None)

    def table_exists(self, namespace: str, table: str) -> bool:
        try:
            self.load_table(namespace, table)
        except TableNotFound:
            return False
        return True

    def namespace_exists(self, namespace: str) -> bool:
        return namespace in self.list_namespaces()

    def create_table(self, namespace: str, table: str, schema: T.StructType, fmt: str = "parquet") -> TableInfo:
        if self.base is None:
            raise ValueError("no base folder for new tables")
        if self.table_exists(namespace, table):
            raise ValueError(f"{namespace}.{table} exists")
        info = TableInfo(f"{self.base}/{namespace}/{table}", fmt, schema=schema)
        serde = {f: part for part, f in self.FORMATS.items()}[fmt]
        columns = [{"Name": f.name, "Type": f.dataType.simpleString()} for f in schema.fields]
        self.client.create_table(DatabaseName=namespace, TableInput={"Name": table, "StorageDescriptor": {"Columns": columns, "Location": info.location, "SerdeInfo": {"SerializationLibrary": serde}}, "Parameters": {}})
        return info


class Registry:
    """Catalogs by name, the current catalog and namespace, and three-part names resolved when they are used."""

    SECRET = re.compile(r"secret|password|token|credential|key", re.I)

    def __init__(self, spark: SparkSession):
        self.spark, self.providers = spark, {}
        self.catalog, self.namespace = "spark_catalog", "default"

    def add(self, name: str, provider: CatalogProvider) -> None:
        self.providers[name] = provider

    def configure(self) -> None:
        """Add providers from `spark.sql.catalog.<name>.type` settings: memory, folder (warehouse), rest (uri), hive. Glue needs a client: `add`."""
        settings = {k: v for k, v in self.spark.sparkContext.getConf().getAll() if k.startswith("spark.sql.catalog.")}
        for k, kind in settings.items():
            if not k.endswith(".type"):
                continue
            name = k[len("spark.sql.catalog.") : -len(".type")]
            own = {x[len(f"spark.sql.catalog.{name}.") :]: v for x, v in settings.items() if x.startswith(f"spark.sql.catalog.{name}.")}
            if kind == "memory":
                self.add(name, MemoryCatalog(own.get("warehouse")))
            elif kind == "folder":
                self.add(name, FolderCatalog(self.spark, own["warehouse"]))
            elif kind in ("rest", "iceberg", "unity"):
                self.add(name, RestCatalog(own["uri"], token=own.get("token")))
            elif kind == "hive":
                self.add(name, HiveCatalog(self.spark))
            else:
                raise ValueError(f"unknown catalog type {kind}")

    def use(self, name: str) -> None:
        """USE catalog, USE catalog.namespace or USE namespace."""
        first, _, rest = name.partition(".")
        if first in self.providers or first == "spark_catalog":
            self.catalog, self.namespace = first, rest or "default"
        else:
            self.namespace = name

    def _split(self, name: str) -> tuple[str, str, str]:
        parts = name.split(".")
        if len(parts) == 1:
            return self.catalog, self.namespace, parts[0]
        if len(parts) == 2:
            return self.catalog, *parts
        return parts[0], ".".join(parts[1:-1]), parts[-1]

    def table(self, name: str) -> DataFrame:
        catalog, namespace, table = self._split(name)
        if catalog == "spark_catalog":
            return self.spark.table(f"{namespace}.{table}")
        return open_table(self.spark, self.providers[catalog].load_table(namespace, table))

    def sql(self, text: str) -> DataFrame:
        """SQL in which three-part names of registered catalogs stand for their tables; each is resolved once, as a temporary view."""

        def view(m: re.Match) -> str:
            name = re.sub(r"\W", "_", m[0]).strip("_")
            self.table(m[0].replace("`", "")).createOrReplaceTempView(name)
            return name

        if not self.providers:
            return self.spark.sql(text)
        names = "|".join(map(re.escape, self.providers))
        return self.spark.sql(re.sub(rf"\b(?:{names})(?:\.`?\w+`?){{2,}}", view, text))

    def create_as(self, name: str, df: DataFrame, fmt: str = "parquet") -> DataFrame:
        """CREATE TABLE AS in a registered catalog."""
        catalog, namespace, table = self._split(name)
        info = self.providers[catalog].create_table(namespace, table, df.schema, fmt)
        df.write.format(fmt).save(info.location)
        return open_table(self.spark, info)

    def show_catalogs(self, like: str = "*") -> list[str]:
        return [n for n in sorted({"spark_catalog", *self.providers}) if fnmatch.fnmatch(n, like)]

    def describe_catalog(self, name: str) -> list[tuple[str, str]]:
        """Name and settings; the values of secrets are not shown."""
        if name != "spark_catalog" and name not in self.providers:
            raise LookupError(name)
        rows = [("Catalog Name", name), ("Provider", type(self.providers.get(name)).__name__ if name in self.providers else "SessionCatalog")]
        for k, v in sorted(self.spark.sparkContext.getConf().getAll()):
            if k.startswith(f"spark.sql.catalog.{name}."):
                rows.append((k.rsplit(".", 1)[1], "*********(redacted)" if self.SECRET.search(k.rsplit(".", 1)[1]) else v))
        return rows


def open_table(spark: SparkSession, info: TableInfo) -> DataFrame:
    if info.format == "delta":
        df = read_delta(spark, info.location)
    elif info.format == "iceberg":
        df = read_iceberg(spark, info.location)
    else:
        df = files.read(spark, info.format, info.location, **info.options)
    return files.adapt(df, info.schema) if info.schema is not None else df
