"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

MAX_ROUNDS = 40
#: So many edges (8 MB) are joined by one task; more of them by rounds over all tasks, with the same result.
ONE_TASK = 500_000


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges (columns a and b, long): root is the smallest node reachable.

    Each round hangs all larger neighbours of a node on its smallest neighbour, first over edges in
    both directions, then from larger to smaller nodes only; a component ends as a star. Rounds are
    written to the shared folder. A node with very many edges costs one combined row for each task.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    now = materialize(edges.where("a <> b").select(a, b).distinct(), "cc")
    mark = _mark(now)
    if mark[0] <= ONE_TASK:
        return now.coalesce(1).mapInArrow(_forest, "node long, root long")
    for _ in range(MAX_ROUNDS):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        before, now = now, materialize(small.select("e.a", "e.b").where("a <> b").distinct(), "cc")
        discard(before)
        new = _mark(now)
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node with the smallest node of its component, by union-find with path halving."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(nodes)))
    for x, y in zip(place[: len(a)].tolist(), place[len(a) :].tolist(), strict=True):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        up[max(x, y)] = min(x, y)
    for i, x in enumerate(up):  # a parent is smaller than its child, so it is settled first
        up[i] = up[x]
    yield pa.record_batch([pa.array(nodes), pa.array(nodes[up])], ["node", "root"])


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
