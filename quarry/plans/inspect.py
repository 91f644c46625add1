"""What a query will do and what it did: plans, pushed filters, exchanges, metrics."""

from __future__ import annotations

import re
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """The text of df.explain(mode): simple, extended, codegen, cost or formatted."""
    explain = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    return df._jdf.queryExecution().explainString(explain)


def pushed_filters(df: DataFrame) -> list[str]:
    return [x.strip() for m in re.findall(r"PushedFilters: \[(.*?)\]\n", plan_text(df)) for x in re.split(r", (?![^(]*\))", m) if x]


def read_schemas(df: DataFrame) -> list[str]:
    return read_schemas_of(plan_text(df))


def read_schemas_of(text: str) -> list[str]:
    return re.findall(r"ReadSchema: (.*)", text)


def exchanges(df: DataFrame) -> int:
    """Shuffles in the plan."""
    return len(re.findall(r"^\(\d+\) Exchange", plan_text(df), re.M))


@dataclass
class QueryStats:
    duration_ms: float
    output_rows: int
    bytes_scanned: int
    metrics: dict[str, int]


def run_with_stats(df: DataFrame) -> QueryStats:
    """Run df without keeping its rows, and return time, rows, the bytes that its tasks read from files, and the executed plan's metrics."""
    seen, sc = Observation("rows"), df.sparkSession.sparkContext
    group = f"stats-{uuid.uuid4().hex}"
    before = sc.getLocalProperty("spark.jobGroup.id")
    sc.setJobGroup(group, "run_with_stats")
    began = time.perf_counter()
    watched = df.observe(seen, F.count(F.lit(1)).alias("n"))
    try:
        watched.write.format("noop").mode("overwrite").save()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", before)
    took = (time.perf_counter() - began) * 1000
    return QueryStats(took, int(seen.get["n"]), _bytes_read(sc, group), _metrics(watched))


def _bytes_read(sc, group: str) -> int:
    jvm = sc._jsc.sc()
    jvm.listenerBus().waitUntilEmpty(30_000)
    stages = {s for j in sc.statusTracker().getJobIdsForGroup(group) for s in sc.statusTracker().getJobInfo(j).stageIds}
    return sum(int(jvm.statusStore().lastStageAttempt(s).inputBytes()) for s in stages)


def _metrics(df: DataFrame) -> dict[str, int]:
    out: dict[str, int] = {}
    it = df._jdf.queryExecution().executedPlan().metrics().iterator()
    while it.hasNext():
        pair = it.next()
        out[pair._1()] = pair._2().value()
    return out
