"""Named queries with their DuckDB oracles."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder

Build = Callable[[SparkSession, str], DataFrame]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Tables that the fixture lacks, derived from others: written once for each session and folder, a subquery in the oracle.
DERIVED = {
    "partsupp": "SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, round(avg(l_extendedprice / l_quantity), 4) AS ps_supplycost, CAST(sum(l_quantity) AS BIGINT) AS ps_availqty FROM {lineitem} GROUP BY l_partkey, l_suppkey",
}
_NAME = re.compile(r"\{(\w+)\}")


@dataclass(frozen=True)
class Query:
    build: Build
    oracle: str | None


class Catalog(dict[str, Query]):
    """Queries by name. `{table}` in SQL text stands for a table of the scale-factor folder."""

    def sql(self, name: str, text: str, oracle: str | None = "") -> None:
        """A query in SQL; without an oracle text DuckDB runs the same text, None means there is none."""
        own = text if oracle == "" else oracle
        self[name] = Query(lambda spark, sf_dir: spark.sql(bind(text, sf_dir, spark)), own and _for_duck(own))

    def frame(self, name: str, oracle: str | None = None):
        """Decorator for a query in the DataFrame API."""

        def add(build: Build) -> Build:
            self[name] = Query(build, oracle)
            return build

        return add


def _for_duck(text: str) -> str:
    return _NAME.sub(lambda m: m[1] if m[1] in TABLES else f"({_for_duck(DERIVED[m[1]])})" if m[1] in DERIVED else m[0], text)


def _view(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A temporary view of a table, made once for each session and folder: its schema and file list are read once."""
    own = spark.__dict__.setdefault("_quarry_views", {})
    if (sf_dir, name) not in own:
        view = f"quarry_{name}_{len(own)}"
        path = f"{sf_dir}/{name}.parquet"
        if name in DERIVED:
            path = f"{shared_folder(spark)}/{view}-{uuid.uuid4().hex}"
            spark.sql(bind(DERIVED[name], sf_dir, spark)).write.parquet(path)
        spark.read.parquet(path).createOrReplaceTempView(view)
        own[sf_dir, name] = view
    return own[sf_dir, name]


def bind(text: str, sf_dir: str, spark: SparkSession | None = None) -> str:
    spark = spark or SparkSession.active()
    return _NAME.sub(lambda m: _view(spark, sf_dir, m[1]) if m[1] in TABLES or m[1] in DERIVED else m[0], text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.table(_view(spark, sf_dir, name))
