"""Joins that the DataFrame API has no single call for: as-of, range, salted and size-checked broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A side is broadcast only if its optimised plan promises at most this many bytes.
BROADCAST_BYTES = 64 << 20


def plan_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of a frame's size, from file sizes or table statistics; an overestimate for filters."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def join_small(big: DataFrame, small: DataFrame, on: Column | list[str], how: str = "inner", most: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast `small` if its size is within the bound; otherwise leave the choice to the planner, which shuffles."""
    return big.join(F.broadcast(small) if plan_bytes(small) <= most else small, on, how)


def salted_join(skewed: DataFrame, other: DataFrame, key: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """Equi-join on a key with few hot values: each row of `skewed` takes one of `salts` parts of its key, and `other` is repeated for all.

    how: inner or left, with the skewed side on the left.
    """
    left = skewed.withColumn("_salt", F.pmod(F.xxhash64(*skewed.columns), F.lit(salts)))
    right = other.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def asof_join(left: DataFrame, right: DataFrame, by: str, on: str, take: list[str], direction: str = "backward", tolerance: str | None = None, cut: str | None = None) -> DataFrame:
    """Each row of `left` with the columns `take` of the nearest row of `right` of the same key.

    backward: the last with right.on <= left.on; forward: the first with right.on >= left.on. The two
    sides are laid into one stream by time and the nearest row is carried along, so a key costs one
    sort, not a product. Among right rows of one time the greatest `take` wins. tolerance: an SQL
    interval beyond which nothing matches. Rows with a null key or time match nothing. cut: a unit of
    date_trunc by which each key's time is cut, so that a key with very many rows is sorted by many
    tasks; the nearest row from the cuts before comes to each cut as one row.
    """
    back = direction == "backward"
    one = left.select(F.col(by).alias("_by"), F.col(on).alias("_on"), F.lit(1 if back else 0).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(F.struct(F.col(on).alias("_t"), *take)).schema[0].dataType).alias("_hit"))
    two = right.where(F.col(by).isNotNull() & F.col(on).isNotNull()).groupBy(F.col(by).alias("_by"), F.col(on).alias("_on")).agg(F.max(F.struct(F.col(on).alias("_t"), *take)).alias("_hit"))
    two = two.select("_by", "_on", F.lit(0 if back else 1).alias("_side"), F.lit(None).cast(one.schema["_row"].dataType).alias("_row"), "_hit")
    # forward is the same running frame over descending time, so both are linear in the rows
    order = [F.col("_on"), F.col("_side")] if back else [F.desc("_on"), F.desc("_side")]
    rows, keys = one.unionByName(two), ["_by"]
    if cut:
        rows, keys = rows.withColumn("_cut", F.date_trunc(cut, "_on")), ["_by", "_cut"]
        far = F.max if back else F.min
        ends = rows.groupBy(*keys).agg(far("_hit").alias("_end"))  # a row for each key and cut
        before = Window.partitionBy("_by").orderBy(F.col("_cut") if back else F.desc("_cut")).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(*keys, F.last("_end", ignorenulls=True).over(before).alias("_end"))
    running = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumn("_hit", F.last("_hit", ignorenulls=True).over(running)).where(F.col("_row").isNotNull())
    if cut:
        out = out.join(ends, keys, "left").withColumn("_hit", F.coalesce("_hit", "_end"))
    sound = F.col("_by").isNotNull() & F.col("_on").isNotNull()
    if tolerance:
        near = F.expr(f"_hit._t >= _on - {tolerance}" if back else f"_hit._t <= _on + {tolerance}")
        sound = sound & near
    return out.select("_row.*", *[F.when(sound, F.col(f"_hit.{c}")).alias(c) for c in take])


def range_join(left: DataFrame, right: DataFrame, by: str, on: str, seconds: int) -> DataFrame:
    """Pairs of one key with left.on < right.on <= left.on + seconds, as columns l.* and r.*.

    Time is cut into bins as long as the range; a left row meets its own bin and the next, so the join
    stays an equi-join on (key, bin) that can be shuffled and split.
    """
    def bin_of(side: str) -> Column:
        return F.floor(F.unix_micros(F.col(f"{side}.{on}").cast("timestamp")) / (seconds * 1_000_000))

    one = left.alias("l").withColumn("_bin", F.explode(F.array(bin_of("l"), bin_of("l") + 1)))
    two = right.alias("r").withColumn("_bin", bin_of("r"))
    span = F.expr(f"INTERVAL {seconds} SECOND")
    on_key = (F.col(f"l.{by}") == F.col(f"r.{by}")) & (one["_bin"] == two["_bin"])
    return one.join(two, on_key & (F.col(f"r.{on}") > F.col(f"l.{on}")) & (F.col(f"r.{on}") <= F.col(f"l.{on}") + span))
