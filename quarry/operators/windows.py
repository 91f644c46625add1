"""Window patterns: sessions by gap, dense daily series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessionize(events: DataFrame, key: str, ts: str, tie: str, gap: str) -> DataFrame:
    """Add `session` (from 1 for each key): a new one starts when the time since the key's last event exceeds `gap` (an SQL interval)."""
    order = Window.partitionBy(key).orderBy(ts, tie)
    fresh = F.when(F.col(ts) - F.lag(ts).over(order) <= F.expr(gap), 0).otherwise(1)
    return events.withColumn("_fresh", fresh).withColumn("session", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def daily_counts(events: DataFrame, key: str, ts: str) -> DataFrame:
    """key, day, n for every day from a key's first to its last event; days without events have 0."""
    daily = events.groupBy(key, F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    order = Window.partitionBy(key).orderBy("day")
    ahead = F.coalesce(F.date_sub(F.lead("day").over(order), 1), F.col("day"))
    return daily.withColumn("_to", ahead).select(key, F.explode(F.sequence("day", "_to")).alias("at"), "day", "n").select(key, F.col("at").alias("day"), F.when(F.col("at") == F.col("day"), F.col("n")).otherwise(0).alias("n"))
