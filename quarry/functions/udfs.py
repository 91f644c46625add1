"""User-defined functions of every kind: Python, pandas, Arrow, aggregate, table and SQL functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.udf(T.StringType())
def initials(name):
    """Row at a time: kept for functions that cannot work on batches."""
    return None if name is None else "".join(w[0] for w in name.replace("_", " ").split())


@F.pandas_udf(T.DoubleType())
def discounted(price: pd.Series, discount: pd.Series) -> pd.Series:
    return price * (1 - discount)


@F.arrow_udf(T.LongType())
def squared(x: pa.Array) -> pa.Array:
    return pc.multiply(pc.cast(x, pa.int64()), pc.cast(x, pa.int64()))


@F.pandas_udf(T.DoubleType())
def geometric_mean(x: pd.Series) -> float:
    """A grouped aggregate; a group meets in one task, so built-in aggregates come first where they exist."""
    import numpy as np

    return float(np.exp(np.log(x).mean()))


@F.udtf(returnType=T.StructType().add("word", T.StringType()).add("place", T.IntegerType()))
class SplitWords:
    """A table function: one row for each word."""

    def eval(self, text: str):
        for i, w in enumerate((text or "").split()):
            yield w, i


@F.udtf(returnType=T.StructType().add("key", T.IntegerType()).add("rows", T.LongType()).add("total", T.DoubleType()))
class SumPartition:
    """A table function over TABLE(...) PARTITION BY: one row for each partition."""

    def __init__(self):
        self.key, self.n, self.total = None, 0, 0.0

    def eval(self, row):
        self.key, self.n, self.total = row[0], self.n + 1, self.total + row[1]

    def terminate(self):
        if self.n:
            yield self.key, self.n, self.total


def centred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas: batches stream through."""
    for b in batches:
        yield b.assign(half=b.iloc[:, 1] / 2)


def register(spark: SparkSession) -> None:
    spark.udf.register("initials", initials)
    spark.udf.register("discounted", discounted)
    spark.udf.register("geometric_mean", geometric_mean)
    spark.udtf.register("split_words", SplitWords)
    spark.udtf.register("sum_partition", SumPartition)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION add_tax(price DOUBLE, rate DOUBLE DEFAULT 0.1) RETURNS DOUBLE RETURN price * (1 + rate)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION numbers_to(n INT) RETURNS TABLE (i INT) RETURN SELECT explode(sequence(1, n))")


def grouped_ranks(df: DataFrame, key: str, value: str) -> DataFrame:
    """applyInPandas for groups of bounded size."""

    def rank(g: pd.DataFrame) -> pd.DataFrame:
        return g.assign(place=g[value].rank(method="first").astype("int64"))

    return df.groupBy(key).applyInPandas(rank, f"{df._jdf.schema().toDDL()}, place long")
