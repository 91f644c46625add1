"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the windows of benchmark items. For patterns of m words, the shift table tells for the
last two words of a position how far the search may jump; only where it says 0 are the patterns of
that suffix bucket compared, first by the words' hashes and then, letter by letter, as text. Items
shorter than a window form patterns of their own length, each length with its own tables. Positions
of many text pieces move in step, in numpy.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary_view, discard, materialize, slices, type_of
from .words import ALNUM, mix

WINDOW = 13
#: Slots of a shift table, and words of a text piece that is searched in step with others.
TABLE_BITS, PIECE = 20, 384
#: Words of benchmark text in one set of tables (about 100 MB a worker); larger benchmarks are searched in blocks.
BLOCK_WORDS = 1_000_000
#: Every byte as a word's letter or as the blank between words.
_LETTERS = bytes(32 if ALNUM.sep[i] else int(ALNUM.lower[i]) for i in range(256))
_MOVE = np.uint64(64 - TABLE_BITS)
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _block(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (mix(before * _FIRST + last * _SECOND) >> _MOVE).astype(np.int64)


class Tables:
    """Shift table and suffix buckets of all patterns with m words."""

    def __init__(self, m: int, patterns: np.ndarray):
        self.m = m
        size = min(m, 2)
        self.jump = m - size + 1
        self.shift = np.full(1 << TABLE_BITS, self.jump, np.uint8)
        for end in range(size - 1, m):
            slot = self.slot(patterns[:, end - 1] if size == 2 else None, patterns[:, end])
            np.minimum.at(self.shift, slot, m - 1 - end)
        tail = self.slot(patterns[:, m - 2] if size == 2 else None, patterns[:, m - 1])
        order = np.argsort(tail, kind="stable")
        self.patterns, self.which, self.tail = patterns[order], order, tail[order]

    @staticmethod
    def slot(before: np.ndarray | None, last: np.ndarray) -> np.ndarray:
        return _block(before if before is not None else np.zeros(len(last), np.uint64), last)

    def search(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and pattern of every occurrence that stays within one text."""
        m = self.m
        sizes = np.diff(bounds)
        per = np.maximum(0, -(-(sizes - m + 1) // PIECE))
        text = np.repeat(np.arange(len(sizes)), per)
        rank = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        at = bounds[text] + rank * PIECE + m - 1  # last word of the position
        stop = np.minimum(at + PIECE, bounds[text + 1]) if len(text) else at
        ends, pats = [], []
        while len(at):
            slot = self.slot(words[at - 1] if m > 1 else None, words[at])
            shift = self.shift[slot].astype(np.int64)
            hit = np.flatnonzero(shift == 0)
            if len(hit):
                e, p = self._compare(words, at[hit], slot[hit])
                ends.append(e)
                pats.append(p)
            at = at + np.maximum(shift, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        if not ends:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(ends) - (m - 1), self.which[np.concatenate(pats)]

    def _compare(self, words: np.ndarray, at: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every pattern of a slot's bucket against the words before `at`, the first word first."""
        lo, n = np.searchsorted(self.tail, slot), np.searchsorted(self.tail, slot, "right")
        n = n - lo
        at = np.repeat(at, n)
        pat = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        for j in range(self.m):
            same = words[at - self.m + 1 + j] == self.patterns[pat, j]
            at, pat = at[same], pat[same]
        return at, pat


class Matcher:
    """All windows of a block of items. items: (item_id, text as bytes)."""

    def __init__(self, items: list[tuple[int, bytes]], window: int = WINDOW):
        found: dict[int, dict[bytes, tuple[np.ndarray, set[int]]]] = defaultdict(dict)
        for item, text in items:
            h, _, _ = ALNUM.spans(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
            words = text.translate(_LETTERS).split()
            m = min(window, len(h))
            for i in range(len(h) - m + 1 if m else 0):
                found[m].setdefault(b" ".join(words[i : i + m]), (h[i : i + m], set()))[1].add(item)
        self.tables = [(Tables(m, np.stack([p for p, _ in w.values()])), list(w), [o for _, o in w.values()]) for m, w in sorted(found.items())]

    def spans(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, set[int]]]]:
        """The first word of each text data[at[i]:at[i+1]], and first word, number of words and items of every occurrence."""
        words, starts, bounds = ALNUM.spans(data, at)
        out = []
        for tables, texts, owners in self.tables:
            start, pattern = tables.search(words, bounds)
            if not len(start):
                continue
            end = start + tables.m  # the text of an occurrence ends before the next word or with its document
            owner = np.searchsorted(bounds, start, "right") - 1
            stop = np.where(end < bounds[owner + 1], starts[np.minimum(end, len(starts) - 1)], at[owner + 1])
            for s, lo, hi, p in zip(start.tolist(), starts[start].tolist(), stop.tolist(), pattern.tolist(), strict=True):
                if b" ".join(data[lo:hi].tobytes().translate(_LETTERS).split()) == texts[p]:
                    out.append((s, tables.m, owners[p]))
        return bounds, out


def find_overlap(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """id_col, n_words, n_hit, items (array of item ids) for every row of docs.

    benchmark has item_id and text. Its items are dealt by hash into blocks of about `block_words`
    words, of which one at a time is on the driver and broadcast; a benchmark of several blocks is
    searched in as many passes, whose spans are merged by document.
    Defined cases: a null or empty text has no words; items without words, or without an id, match
    nothing; repeated items count once; an empty benchmark hits nothing; ids of docs may have any
    type, repeat or be null; other columns of both tables are not read.
    """
    named = benchmark.where("item_id is not null and text is not null").select("item_id", F.col("text").cast("binary").alias("text"))
    n_words = named.agg(F.coalesce(F.sum(F.octet_length("text") / 2 + 1), F.lit(0))).first()[0]  # a word and its blank have two bytes at least
    blocks = max(1, -(-int(n_words) // block_words))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    kind = type_of(docs, id_col)
    if blocks == 1:
        held = docs.sparkSession.sparkContext.broadcast(_items(named))
        out = rows.mapInArrow(_one_block(held, window), f"_id {kind}, n_words long, n_hit long, items array<long>")
        return out.withColumnRenamed("_id", id_col)
    return _many_blocks(rows, named, blocks, window, kind).withColumnRenamed("_id", id_col)


def _items(named: DataFrame) -> list[tuple[int, bytes]]:
    return [(item, bytes(text)) for item, text in named.collect()]


def _one_block(held, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(held.value, window)
        for whole in batches:
            for b in slices(whole, "_text"):
                bounds, spans = matcher.spans(*binary_view(b.column(1)))
                mark = np.zeros(int(bounds[-1]) + 1, np.int32)
                items: dict[int, set[int]] = defaultdict(set)
                for start, m, own in spans:
                    mark[start] += 1
                    mark[start + m] -= 1
                    items[int(np.searchsorted(bounds, start, "right")) - 1].update(own)
                hit = np.concatenate([[0], np.cumsum(np.cumsum(mark[:-1]) > 0)])
                n_hit = hit[bounds[1:]] - hit[bounds[:-1]]
                lists = [sorted(items.get(i, ())) for i in range(len(b))]
                yield pa.record_batch([b.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(n_hit, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["_id", "n_words", "n_hit", "items"])

    return run


def _many_blocks(rows: DataFrame, named: DataFrame, blocks: int, window: int, kind: str) -> DataFrame:
    """One pass and one written table for each block, with the merged spans of the documents that it hits; then their union by document."""
    sc, found = rows.sparkSession.sparkContext, []
    keyed = rows.withColumn("_key", F.xxhash64(F.coalesce("_text", F.lit(b""))))
    dealt = materialize(named.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))).repartition("block").sortWithinPartitions("block"), "benchmark")
    for block in range(blocks):
        held = sc.broadcast(_items(dealt.where(F.col("block") == block).drop("block")))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(held.value, window)
            for whole in batches:
                for b in slices(whole, "_text"):
                    bounds, occurrences = matcher.spans(*binary_view(b.column(1)))
                    places: dict[int, set[int]] = defaultdict(set)
                    items: dict[int, set[int]] = defaultdict(set)
                    for start, m, own in occurrences:
                        d = int(np.searchsorted(bounds, start, "right")) - 1
                        places[d].update(range(start - int(bounds[d]), start - int(bounds[d]) + m))
                        items[d].update(own)
                    hit = sorted(places)
                    lists = pa.list_(pa.int64())
                    yield pa.record_batch([b.column(2).take(pa.array(hit, pa.int64())), pa.array([sorted(places[d]) for d in hit], lists), pa.array([sorted(items[d]) for d in hit], lists)], ["_key", "places", "items"])

        found.append(materialize(keyed.select("_id", "_text", "_key").mapInArrow(run, "_key long, places array<long>, items array<long>"), "hits"))
        held.unpersist()
    discard(dealt)
    # equal texts have equal hits, so one row for each text is enough
    every = functools.reduce(DataFrame.unionAll, [f.dropDuplicates(["_key"]) for f in found])
    merged = every.groupBy("_key").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    merged = materialize(merged, "hits")
    discard(*found)
    short = keyed.select("_id", "_key", "_text").mapInArrow(_count_words, f"_id {kind}, _key long, n_words long")
    return short.join(merged, "_key", "left").select("_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in slices(whole, "_text"):
            _, _, bounds = ALNUM.spans(*binary_view(b.column(2)))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(np.diff(bounds), pa.int64())], ["_id", "_key", "n_words"])


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """The contamination rule: at least a twentieth of the words are hit."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the contaminated ones. Rows without an id stay; rows that repeat an id go together."""
    bad = find_overlap(docs, benchmark, id_col, text_col).where(contaminated(F.col("n_hit"), F.col("n_words"))).select(id_col).distinct()
    return docs.join(bad, id_col, "left_anti").select(*docs.columns)
