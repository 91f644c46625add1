"""Structured Streaming pipelines: file sources, event-time windows, deduplication, joins, custom state, and a query manager."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import shared_folder


def file_stream(spark: SparkSession, sf_dir: str, name: str, event_time: str | None = None) -> DataFrame:
    """A table's files as a stream; event_time is cast to a timestamp, which watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    path, glob = f"{sf_dir}/{name}.parquet", None
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(fs_path).isFile():  # streams read folders
        path, glob = sf_dir, f"{name}.parquet"
    reader = spark.readStream.schema(schema)
    stream = (reader.option("pathGlobFilter", glob) if glob else reader).parquet(path)
    return stream.withColumn(event_time, F.col(event_time).cast("timestamp")) if event_time else stream


def tumbling(stream: DataFrame, ts: str, width: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sliding(stream: DataFrame, ts: str, width: str, slide: str, keys: list[str], delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(ts, delay).groupBy(F.window(ts, width, slide), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(stream: DataFrame, ts: str, gap: str, key: str, delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), key, "n")


def deduplicated(stream: DataFrame, keys: list[str], ts: str | None = None, delay: str | None = None) -> DataFrame:
    """One row for each key: for ever, or within the watermark's delay (bounded state)."""
    if ts and delay:
        return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
    return stream.dropDuplicates(keys)


def interval_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, within: str, delay: str = "1 hour") -> DataFrame:
    """Stream-stream join of one key with right time in (left time, left time + within]; both sides' state is bounded by the watermarks."""
    one, two = left.withWatermark(left_ts, delay).alias("l"), right.withWatermark(right_ts, delay).alias("r")
    span = F.expr(f"INTERVAL {within}")
    return one.join(two, (F.col(f"l.{key}") == F.col(f"r.{key}")) & (F.col(f"r.{right_ts}") > F.col(f"l.{left_ts}")) & (F.col(f"r.{right_ts}") <= F.col(f"l.{left_ts}") + span))


def running_totals(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Custom state: rows and sum so far for each key, emitted with every batch."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    kind = stream.schema[key].dataType.simpleString()
    out = f"{key} {kind}, n long, total double"
    return stream.select(key, value).groupBy(key).applyInPandasWithState(update, out, "n long, total double", "update", GroupStateTimeout.NoTimeout)


def run_to_memory(stream: DataFrame, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all that is there now and return the sink's rows as a batch frame."""
    name = f"sink_{uuid.uuid4().hex}"
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    writer.start().awaitTermination()
    return stream.sparkSession.table(name)


def run_stored(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, write each batch's rows to the shared folder, and return them as a batch frame.

    In complete mode that is the last batch. Nothing passes through the driver.
    """
    spark, base = stream.sparkSession, f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    done: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/{number}")
        done.append(number)

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/offsets").trigger(availableNow=True).start().awaitTermination()
    own = sorted(set(done))[-1:] if mode == "complete" else sorted(set(done))
    return spark.read.schema(stream.schema).parquet(*[f"{base}/rows/{n}" for n in own]) if own else spark.createDataFrame([], stream.schema)


def run_to_files(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> None:
    """Run to a file sink; files and checkpoint together give each row exactly once."""
    stream.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_each_batch(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Each micro-batch as a batch frame, written to a folder named by its number: a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class _Latest(StatefulProcessor):
    """Rows so far and the largest value, for each key."""

    def __init__(self, key: str, value: str):
        self.key, self.value = key, value

    def init(self, handle) -> None:
        self.state = handle.getValueState("seen", "n long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        n, last = self.state.get() if self.state.exists() else (0, -(1 << 63))
        for f in rows:
            n, last = n + len(f), max(last, int(f[self.value].max()))
        self.state.update((n, last))
        yield pd.DataFrame({self.key: [key[0]], "n": [n], "last": [last]})

    def close(self) -> None:
        pass


def latest_by_key(stream: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, last with every batch, by a stateful processor (its state needs the RocksDB store)."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).transformWithStateInPandas(_Latest(key, value), f"{key} {kind}, n long, last long", "Append", "None")


class QueryManager:
    """Start, look at, drain and stop named streaming queries."""

    def __init__(self, spark: SparkSession, checkpoints: str | None = None):
        self.spark, self.checkpoints, self.own = spark, checkpoints, {}

    def start(self, name: str, stream: DataFrame, fmt: str = "memory", mode: str = "append", trigger: dict | None = None, **options: str) -> StreamingQuery:
        base = self.checkpoints or shared_folder(self.spark)
        writer = stream.writeStream.format(fmt).queryName(name).outputMode(mode).options(**options)
        if fmt != "memory" or mode == "complete":
            writer = writer.option("checkpointLocation", f"{base}/{name}")
        self.own[name] = writer.trigger(**(trigger or {"availableNow": True})).start()
        return self.own[name]

    def status(self, name: str) -> dict:
        q = self.own[name]
        return {"id": str(q.id), "run_id": str(q.runId), "active": q.isActive, **q.status, "last_progress": q.lastProgress}

    def drain(self, name: str) -> None:
        self.own[name].processAllAvailable()

    def await_all(self, seconds: int | None = None) -> bool:
        return all(q.awaitTermination(seconds) is not False for q in self.own.values())

    def stop(self, name: str) -> None:
        self.own.pop(name).stop()


def rate_stream(spark: SparkSession, rows_per_second: int = 10) -> DataFrame:
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def spool_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "json") -> DataFrame:
    """A folder that another process drops files into, as a message queue's spool."""
    return spark.readStream.schema(schema).format(fmt).load(path)
