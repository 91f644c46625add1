"""Sharding by histogram sort.

Rows are ordered by a 64-bit key, within one key by id, and rows that agree in both by a number of
their own. Every round counts the exact bytes and rows below a set of candidate boundaries in all
partitions at once, and moves the candidates closer to the wanted byte totals, until every splitter
meets its tolerance. Then rows are exchanged once.
The counts below the splitters also give each partition's first slot, so no shard meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, shuffle_partitions

_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
_COUNTS = "cell int, bytes long, rows long"
#: Candidates for each splitter and round.
PROBES = 32
MAX_ROUNDS = 80


#: The columns rows are ordered by, all long.
ORDER = ("key", "ident", "tie")
Boundary = tuple[int, int, int]


def _histogram(rows: DataFrame, bounds: list[Boundary]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows below each of the sorted boundaries; each task sends one row for each cell at most."""
    sides = _columns(bounds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(len(bounds) + 1, np.int64), np.zeros(len(bounds) + 1, np.int64)
        for b in batches:
            *at, size = (c.to_numpy() for c in b.columns)
            cell = cells(at, sides)
            np.add.at(sums, cell, size)
            n += np.bincount(cell, minlength=len(n))
        some = np.flatnonzero(n)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(sums[some]), pa.array(n[some])], ["cell", "bytes", "rows"])

    got = rows.select(*ORDER, "size").mapInArrow(count, _COUNTS).groupBy("cell").agg(F.sum("bytes"), F.sum("rows")).collect()
    sums, n = np.zeros(len(bounds) + 1, np.int64), np.zeros(len(bounds) + 1, np.int64)
    for c, b, r in got:  # at most one row for each candidate
        sums[c], n[c] = b, r
    return np.cumsum(sums), np.cumsum(n)


def _columns(bounds: list[Boundary]) -> list[np.ndarray]:
    return [np.array([b[i] for b in bounds], np.int64) for i in range(len(ORDER))]


def cells(at: list[np.ndarray], bounds: list[np.ndarray]) -> np.ndarray:
    """How many of the sorted boundaries are at or below each row. at, bounds: columns in the order of comparison."""
    lo, hi = np.searchsorted(bounds[0], at[0], "left"), np.searchsorted(bounds[0], at[0], "right")
    if len(at) == 1:
        return hi
    out = lo.copy()
    for k in np.unique(lo[hi > lo]).tolist():  # a value that boundaries cut by the columns behind
        own = np.flatnonzero((lo == k) & (hi > lo))
        end = int(hi[own[0]])
        out[own] = k + cells([c[own] for c in at[1:]], [c[k:end] for c in bounds[1:]])
    return out


class _Splitter:
    """The search for one byte total: an interval of boundaries and the counts at its ends."""

    def __init__(self, target: float, total: int, count: int):
        self.target, self.lo, self.hi = target, (_LOW,) * 3, (_HIGH,) * 3
        self.below = {self.lo: (0, 0), self.hi: (total, count)}

    def probes(self) -> list[Boundary]:
        """Boundaries between the two ends: by the first column in which there is room, else by the next one."""
        for i in range(len(ORDER)):
            front = self.lo[:i]
            lo = self.lo[i]
            # behind the last value where the columns in front of it differ
            hi, rest = (self.hi[i], self.hi[i + 1 :]) if self.hi[:i] == front else (_HIGH + 1, ())
            if hi - lo > 1:
                step = max(1, (hi - lo) // (PROBES + 1))
                return [(*front, x, *[_LOW] * (2 - i)) for x in range(lo + step, hi, step)][:PROBES]
            if hi - lo == 1 and any(x != _LOW for x in rest):
                return [(*front, hi, *[_LOW] * (2 - i))]
        return []

    def refine(self, bounds: list[Boundary], sums: np.ndarray, n: np.ndarray) -> None:
        for k, b, r in zip(bounds, sums.tolist(), n.tolist(), strict=False):
            if self.lo <= k <= self.hi:
                if b <= self.target and k > self.lo:
                    self.lo, self.below[k] = k, (b, r)
                elif b > self.target and k < self.hi:
                    self.hi, self.below[k] = k, (b, r)

    def best(self) -> tuple[Boundary, int, int]:
        k = min((self.lo, self.hi), key=lambda k: abs(self.below[k][0] - self.target))
        return k, *self.below[k]

    def done(self, tolerance: float) -> bool:
        """Whole keys suffice as soon as one end is near enough; else one row at most may be left between."""
        return abs(self.best()[1] - self.target) <= tolerance or self.below[self.hi][1] - self.below[self.lo][1] <= 1 or not self.probes()


def splitters(rows: DataFrame, targets: list[float], tolerance: list[float], total: int, count: int) -> list[tuple[Boundary, int, int]]:
    """The boundary, the bytes below and the rows below for every target."""
    search = [_Splitter(t, total, count) for t in targets]
    for _ in range(MAX_ROUNDS):
        bounds = sorted({p for s, e in zip(search, tolerance, strict=True) if not s.done(e) for p in s.probes()})
        if not bounds:
            return [s.best() for s in search]
        sums, n = _histogram(rows, bounds)
        for s in search:
            s.refine(bounds, sums, n)
    raise RuntimeError(f"splitters did not settle in {MAX_ROUNDS} rounds")


def shard_by_bytes(rows: DataFrame, n_shards: int = 16, tolerance: float = 1e-3, pieces: int | None = None) -> DataFrame:
    """Add `shard` and the gapless `slot` to rows with the columns key, ident, tie, size (all long, not null) and any others.

    Every shard's bytes differ from the even share by `tolerance` of it, or by the one row that lies
    on the boundary. Rows of one key stay together wherever the tolerance allows a boundary beside
    them; a key with more bytes is cut by ident, and one (key, ident) with more bytes by tie, which no
    two rows share.
    pieces: exchange partitions for each shard. An empty table gives no rows.
    """
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    spark = rows.sparkSession
    pieces = pieces or max(1, -(-2 * shuffle_partitions(spark) // n_shards))
    n = n_shards * pieces
    share = total / n_shards
    targets = [total * i / n for i in range(1, n)]
    slack = [tolerance * share if i % pieces == 0 else 0.1 * total / n for i in range(1, n)]
    found = splitters(rows, targets, slack, total, count) if count else []
    bounds = [((_LOW,) * 3, 0, 0), *found]
    for i in range(1, len(bounds)):  # a hot row can be larger than a piece: boundaries never step back
        bounds[i] = max(bounds[i], bounds[i - 1])
    sides = _columns([b[0] for b in bounds[1:]])
    start = [b[2] for b in bounds] or [0]
    fields = f"{rows._jdf.schema().toDDL()}, piece int"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            piece = cells([b.column(c).to_numpy() for c in ORDER], sides)
            yield pa.record_batch([*b.columns, pa.array(piece, pa.int32())], [*b.schema.names, "piece"])

    # one short row for each piece: shard and the slot of the piece's first row
    table = spark.createDataFrame([(i, i // pieces, start[i] - start[i // pieces * pieces]) for i in range(len(start))], "piece int, shard int, base long")
    within = Window.partitionBy("piece").orderBy(*ORDER)
    return (
        rows.mapInArrow(place, fields)
        .withColumn("row", F.row_number().over(within))
        .join(F.broadcast(table), "piece")
        .withColumn("slot", F.col("base") + F.col("row") - 1)
        .drop("piece", "row", "base")
    )


def document_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tie: Column | None = None) -> DataFrame:
    """One short row for each document: doc_id, size, text_crc32, and key, ident and tie for the sort.

    Equal texts have one key, so copies meet in one shard where the byte law allows. A null text has
    no bytes (size 1, checksum 0); a row without id sorts before the others of its text. tie is a
    number of each row, by default as they are read.
    """
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(data).cast("long") + 1).alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.xxhash64(data).alias("key"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LOW)).alias("ident"),
        (F.monotonically_increasing_id() if tie is None else tie).alias("tie"),
    )


def shard_documents(docs: DataFrame, n_shards: int = 16, tolerance: float = 1e-3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every document, repeated rows and rows without an id among them."""
    rows = materialize(document_keys(docs, id_col, text_col), "shard-keys")
    return shard_by_bytes(rows, n_shards, tolerance).drop(*ORDER)


def write_shards(docs: DataFrame, path: str, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write whole documents as Parquet, one folder `shard=i` for each shard, in slot order within each file.

    Every row is written once, with its slot; rows may repeat or have no id. Columns of docs named
    slot or shard are replaced. The documents are copied to the shared folder first, numbered.
    """
    whole = materialize(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("tie")), "documents")
    keys = materialize(document_keys(whole, f"doc.`{id_col}`", f"doc.`{text_col}`", F.col("tie")), "shard-keys")
    placed = shard_by_bytes(keys, n_shards).select("tie", "shard", "slot")
    own = [F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in ("shard", "slot")]
    out = whole.join(placed, "tie").select(*own, "slot", "shard")
    out.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    discard(whole, keys)
