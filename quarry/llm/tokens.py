"""Token counts, encoding and decoding of text columns with a public byte-level BPE file."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Codec, Counter, Encoder
from .common import slices, type_of


@functools.cache
def codec(path: str) -> Codec:
    """One codec for each worker process and file."""
    return Codec(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for whole in batches:
        for b in slices(whole, "text", 1 << 21):
            yield b, [x.decode("utf-8", "replace") if x is not None else "" for x in b.column(1).to_pylist()]


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", budgets: list[int] | None = None, prefixes: bool = False) -> DataFrame:
    """id_col, n_bytes, n_tokens for every row, from the prefix tables of its pieces.

    budgets: adds `cut`, an array with the characters of the longest prefix within each budget.
    prefixes: adds `prefix_tokens`, the exact count of every prefix by characters, entry 0 first.
    Defined cases: a null text counts as empty; the empty text has no tokens; ids may have any type, repeat or
    be null; other columns are not read; an empty table gives no rows.
    path: a vocabulary file that every worker has.
    """
    schema, budgets = f"_id {type_of(docs, id_col)}, n_bytes long, n_tokens long", budgets or []
    schema += (", cut array<int>" if budgets else "") + (", prefix_tokens array<int>" if prefixes else "")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(codec(path))
        for b, texts in _texts(batches):
            sizes = [len(t.encode()) for t in texts]
            cols = {"_id": b.column(0), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(list(map(count, texts)), pa.int64())}
            if budgets or prefixes:
                tables = list(map(count.prefix_table, texts))
            if budgets:
                cols["cut"] = pa.array([[max(i for i, c in enumerate(t) if c <= most) for most in budgets] for t in tables], pa.list_(pa.int32()))
            if prefixes:
                cols["prefix_tokens"] = pa.array(tables, pa.list_(pa.int32()))
            yield pa.record_batch(list(cols.values()), list(cols))

    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and `ids` (array of int) for every row. A null text counts as empty; ids are as in `count_tokens`."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(codec(path))
        for b, texts in _texts(batches):
            yield pa.record_batch([b.column(0), _lists(list(map(encode, texts)))], ["_id", "ids"])

    return rows.mapInArrow(run, f"_id {type_of(docs, id_col)}, ids array<int>").withColumnRenamed("_id", id_col)


def _lists(rows: list[bytes]) -> pa.Array:
    at = np.cumsum([0, *(len(r) // 4 for r in rows)])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(b"".join(rows), np.int32)))


def decode_ids(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and `text` for every row. Null ids give a null text; bytes that are not UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            texts = [None if x is None else own.decode(np.array(x, np.int64)) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], ["_id", "text"])

    return rows.select(F.col(id_col).alias("_id"), ids_col).mapInArrow(run, f"_id {type_of(rows, id_col)}, text string").withColumnRenamed("_id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit) and decoded_sha256 for every row, in one pass.

    Defined cases: as in `count_tokens`; the empty text has the digests of no bytes.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        encode = Encoder(own)
        for b, texts in _texts(batches):
            n, ids_sha, text_sha = [], [], []
            for t in texts:
                ids = encode(t)
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(np.frombuffer(ids, np.uint32)).encode()).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"_id {type_of(docs, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("_id", id_col)
