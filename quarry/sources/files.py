"""File readers and writers: every path, option and schema is honoured."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "csv", "json", "orc", "text", "xml", "binaryFile")


def read(spark: SparkSession, fmt: str, *paths: str, schema: str | T.StructType | None = None, **options: str) -> DataFrame:
    """Read all paths with a schema and options; without a schema it is inferred from the files."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}; known: {', '.join(FORMATS)}")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(list(paths))


def load_tables(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, DataFrame]:
    """Tables of a folder by name, each also a temporary view."""
    out = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    for n, df in out.items():
        df.createOrReplaceTempView(n)
    return out


def adapt(df: DataFrame, declared: T.StructType) -> DataFrame:
    """df with a declared schema: columns found without regard to case and cast, missing nullable ones null, others an error.

    The scan keeps the files' own types, so that readers which reject a wider declared type still work.
    """
    found = {c.lower(): c for c in df.columns}
    cols = []
    for f in declared.fields:
        if (own := found.get(f.name.lower())) is not None:
            cols.append(_bridge(df, own, f.dataType).alias(f.name))
        elif f.nullable:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
        else:
            raise ValueError(f"the files have no column {f.name}, which must not be null")
    return df.select(*cols)


def _bridge(df: DataFrame, name: str, to: T.DataType):
    """A cast that also takes integers to dates (days) and timestamps (seconds)."""
    col, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, T.IntegralType):
        if isinstance(to, T.DateType):
            return F.date_from_unix_date(col.cast("int"))
        if isinstance(to, T.TimestampNTZType):
            return F.timestamp_seconds(col).cast("timestamp_ntz")
    return col.cast(to)


def read_partitioned(spark: SparkSession, base: str, where: str | None = None, fmt: str = "parquet") -> DataFrame:
    """A folder of k=v folders; a predicate on partition columns prunes folders before any file is opened."""
    df = spark.read.option("basePath", base).format(fmt).load(base)
    return df.where(where) if where else df


def write(df: DataFrame, fmt: str, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None, **options: str) -> None:
    writer = df.write.format(fmt).mode(mode).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int, mode: str = "overwrite") -> None:
    """A table bucketed and sorted by keys: joins and aggregates on them need no exchange."""
    df.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
