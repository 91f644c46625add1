"""Aggregation patterns beyond one groupBy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def two_phase(lines: DataFrame, keys: list[str], salts: int = 16) -> DataFrame:
    """Sum of price, mean of quantity and count by keys, with hot keys cut by a salt.

    Spark combines on the map side by itself; the salt helps where many distinct values of an
    aggregate (collect, distinct) or a following window would gather one key in one task. AVG is
    carried as SUM and COUNT.
    """
    part = lines.withColumn("_salt", F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(salts))).groupBy(*keys, "_salt")
    part = part.agg(F.sum("l_extendedprice").alias("s"), F.sum("l_quantity").alias("q"), F.count("l_quantity").alias("c"), F.count("*").alias("n"))
    return part.groupBy(*keys).agg(F.sum("s").alias("s"), (F.sum("q") / F.sum("c")).alias("a"), F.sum("n").alias("n"))


def prefix_sums(df: DataFrame, order: str, value: str, name: str, bucket: Column) -> DataFrame:
    """df with the running total of a number in the order of a column, without one task for all rows.

    bucket: an expression on `order` that never falls as it rises, such as its month. Each bucket is
    summed by a task of its own; the sums of the buckets before, one row for each, are added. Rows that
    tie in `order` have the same total.
    """
    cut = df.withColumn("_bucket", bucket)
    base = F.sum("_sum").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    before = cut.groupBy("_bucket").agg(F.sum(value).alias("_sum")).select("_bucket", base.alias("_base"))
    within = F.sum(value).over(Window.partitionBy("_bucket").orderBy(order))
    out = cut.withColumn(name, within).join(before, cut["_bucket"].eqNullSafe(before["_bucket"])).drop("_bucket")
    return out.withColumn(name, F.col(name) + F.coalesce("_base", F.lit(0))).drop("_base")
