"""Helpers that the corpus operators share: intermediate tables, Arrow access, sizing."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Path of each intermediate table of this process -> the session that wrote it.
_written: dict[str, SparkSession] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset (tests on a local master) a temporary folder is made and set.
    On a cluster an unset folder is an error, because executors could not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="quarry-")
    spark.conf.set("spark.checkpoint.dir", made)
    spark.sparkContext.setCheckpointDir(made)
    return made


@contextlib.contextmanager
def _conf(spark: SparkSession, **values: str) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, tag: str, rows_a_batch: int | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs only the tasks that read the table. The shuffle
    files of the step go as soon as it is written. The table stays until `discard`, or else until
    the driver's process ends, as the frame that comes back is lazy.
    rows_a_batch: rows of an Arrow batch, where rows are long.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry-{tag}-{uuid.uuid4().hex}"
    how = {_CLEANUP: "true"} | ({_BATCH: str(rows_a_batch)} if rows_a_batch else {})
    with _conf(spark, **how):
        df.write.parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the tables behind frames that `materialize` gave back, once all that reads them has been written."""
    for f in frames:
        _delete(f._quarry_path)


def _delete(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is not None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def release() -> None:
    """Delete the intermediate tables that are left."""
    for path in list(_written):
        try:
            _delete(path)
        except Exception:  # the session has ended: the folder's owner cleans it
            return


def type_of(df: DataFrame, column: str) -> str:
    """The SQL name of a column's type."""
    return df.schema[column].dataType.simpleString()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def binary_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow binary column; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    base = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return base[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about `most` bytes of the binary column each, one row at least."""
    _, at = binary_view(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < len(batch):
        end = max(start + 1, int(np.searchsorted(at, at[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def whole_groups(batches: Iterator[pa.RecordBatch], by: int = 1) -> Iterator[pa.RecordBatch]:
    """Batches cut anew so that rows that agree in the first `by` columns, which follow one another, stay together."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        names = [b.column(i).to_numpy() for i in range(by)]
        other = np.flatnonzero(np.logical_or.reduce([x != x[-1] for x in names]))
        if not len(other) and (not held or all(held[0].column(i)[0].as_py() == names[i][0] for i in range(by))):
            held.append(b)  # the group goes on
            continue
        end = int(other[-1]) + 1 if len(other) else 0
        yield pa.Table.from_batches([*held, b.slice(0, end)]).combine_chunks().to_batches()[0]
        held = [b.slice(end)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
