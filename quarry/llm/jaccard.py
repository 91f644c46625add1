"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, then exact intersection.

Texts with one and the same shingle set form a class; classes are joined, not rows. Two sets that
are similar enough share one of the first shingles of each in any fixed order (the prefix rule), so
classes meet in the tile of a shared prefix shingle. The order puts shingles that many texts hold
last, which leaves the tiles small; it is only a hint, and results never depend on it. A pair is
looked for in the tile of its first common shingle: from its places there on, both sets must have
enough shingles left for the overlap wanted. A tile with
many classes is cut into bands of set size, and bands into blocks; only blocks whose sizes can reach
the similarity meet. Within a tile, bit counts of hashed bitmaps bound the overlap from above; what
is left is decided by the exact intersection of the sorted arrays.

Shingles are compared as 64-bit hashes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_view, discard, materialize, slices, whole_groups
from .components import connected_components
from .words import BLANKS, mix, shingles

#: A shingle counts as frequent from here on; the list of frequent ones holds at most FREQUENT_MOST (16 MB).
FREQUENT_FROM, FREQUENT_MOST = 8, 1_000_000
#: Rows of an Arrow batch that holds whole texts.
TEXT_ROWS = 2048
#: Shingles a task gathers before it looks for repeated ones.
GATHER = 2_000_000
#: Bits of a signature, and classes of one block of a tile.
BITS, BLOCK = 1024, 256
#: Tiles of so many classes at most give their pairs before signatures are fetched for them.
SMALL = 32
#: Bits of the filter that says which classes are wanted (16 MB at most).
FILTER_BITS = 1 << 27


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _class(own: np.ndarray) -> int:
    """A 64-bit name of a shingle set."""
    total = mix(own * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) + np.uint64(len(own))
    return int(mix(np.array([total]))[0].view(np.int64))


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for whole in batches:
        for b in slices(whole, "text", 1 << 20):
            h, _, bounds = BLANKS.spans(*binary_view(b.column(b.schema.get_field_index("text"))))
            yield b, shingles(h, bounds, k)


def _need(n, num: int, den: int):
    """The least overlap with a set of n shingles."""
    return -(-num * n // den)


def profile(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """kind 0: a = id, b = class, n = set size, sig = bitmap signature, wide = a longer one for larger sets. kind 1: a shingle a that n texts of one gathering hold, n > 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held, size = [], 0
        for b, sets in _sets(batches, k):
            names = [_class(s) for s in sets]
            for c, s in zip(names, sets, strict=True):
                if c not in seen:
                    seen.add(c)
                    held.append(s)
                    size += len(s)
            n = len(b)
            yield _profile_rows(0, b.column(0).cast(pa.int64()), pa.array(names, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([_signature(s) for s in sets], pa.binary()), pa.array([_signature(s, _width(len(s))) if len(s) > BITS else None for s in sets], pa.binary()), n)
            if size >= GATHER:
                yield _repeated(held)
                held, size = [], 0
        if held:
            yield _repeated(held)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "kind int, a long, b long, n long, sig binary, wide binary")


def _profile_rows(kind: int, a: pa.Array, b: pa.Array, n: pa.Array, sig: pa.Array, wide: pa.Array, rows: int) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.full(rows, kind, np.int32)), a, b, n, sig, wide], ["kind", "a", "b", "n", "sig", "wide"])


def _repeated(held: list[np.ndarray]) -> pa.RecordBatch:
    u, c = np.unique(np.concatenate(held), return_counts=True)
    u, c = u[c > 1], c[c > 1]
    return _profile_rows(1, pa.array(_signed(u)), pa.array(np.zeros(len(u), np.int64)), pa.array(c), pa.nulls(len(u), pa.binary()), pa.nulls(len(u), pa.binary()), len(u))


def _frequent(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles, sorted, and their counts: a list of bounded size, as the threshold rises with the corpus."""
    sums = found.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_FROM)
    sums = materialize(sums, "frequent")  # a sum for each shingle that repeats within a gathering
    steps = [FREQUENT_FROM << i for i in range(40)]
    over = sums.agg(*[F.count_if(F.col("n") >= s).alias(f"s{i}") for i, s in enumerate(steps)]).first()
    least = next(s for s, c in zip(steps, over, strict=True) if c <= FREQUENT_MOST)
    got = sums.where(F.col("n") >= least).toArrow()
    key, n = got.column("a").to_numpy().view(np.uint64), got.column("n").to_numpy()
    discard(sums)
    order = np.argsort(key)
    return key[order], n[order]


def prefix_rows(docs: DataFrame, frequent, k: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """key, cls, hot, pos: the prefix shingles of every class and their places in its order; hot ones are on the frequent list."""
    held = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, count = held.value
        seen: set[int] = set()
        for _, sets in _sets(batches, k):
            keys, names, hots, places, sizes = [], [], [], [], []
            for s in sets:
                c = _class(s)
                if not len(s) or c in seen:
                    continue
                seen.add(c)
                take = len(s) - _need(len(s), num, den) + 1
                if len(often):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    hot = often[at] == s
                else:
                    hot = np.zeros(len(s), bool)
                own = s[~hot][:take]
                more = take - len(own)
                if more:
                    rest = s[hot]
                    rest = rest[np.lexsort((rest, count[at[hot]]))[:more]]
                    own = np.concatenate([own, rest])
                keys.append(own)
                hots.append(np.arange(take) >= take - more)
                places.append(np.arange(take, dtype=np.int32))
                names.append(c)
                sizes.append(take)
            if keys:
                yield pa.record_batch([pa.array(_signed(np.concatenate(keys))), pa.array(np.repeat(np.array(names, np.int64), sizes)), pa.array(np.concatenate(hots)), pa.array(np.concatenate(places))], ["key", "cls", "hot", "pos"])

    rows = docs.select(F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "key long, cls long, hot boolean, pos int")


def _shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order of key and class, the keys of more than one class; hot rows pass, each once."""
    last: tuple[int, int, int] | None = None
    last_hot = None
    waiting = False  # the last row so far is alone with its key
    for b in batches:
        key, cls, hot, pos = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        rows = [x[hot] for x in (key, cls, pos)]
        once = np.ones(len(rows[0]), bool)  # copies of a text in several tasks give the same rows
        once[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
        if len(once):
            once[0] = (rows[0][0], rows[1][0]) != last_hot
            last_hot = (rows[0][-1], rows[1][-1])
        out = [[x[once] for x in rows]]
        rows = [x[~hot] for x in (key, cls, pos)]
        if len(rows[0]):
            if last is not None:
                rows = [np.concatenate([[x], y]) for x, y in zip(last, rows, strict=True)]
            fresh = np.ones(len(rows[0]), bool)
            fresh[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
            continued = last is not None and not waiting
            key, cls, pos = (x[fresh] for x in rows)
            same = key[1:] == key[:-1]
            shared = np.zeros(len(key), bool)
            shared[1:] |= same
            shared[:-1] |= same
            if continued:
                own = key == key[0]
                shared[own] = True
                shared[0] = False  # already given out
            waiting = not shared[-1] and not (continued and key[-1] == key[0])
            last = (key[-1], cls[-1], pos[-1])
            out.append([key[shared], cls[shared], pos[shared]])
        key, cls, pos = (np.concatenate(x) for x in zip(*out, strict=True))
        if len(key):
            yield pa.record_batch([pa.array(key, pa.int64()), pa.array(cls, pa.int64()), pa.array(pos, pa.int32())], ["key", "cls", "pos"])


def class_filter(classes: DataFrame, count: int) -> np.ndarray:
    """Bits of the classes wanted; a bit can stand for others too, which a join sorts out."""
    bits = min(FILTER_BITS, max(1 << 18, 1 << (64 * count).bit_length()))
    rows = classes.select(F.pmod("cls", F.lit(bits)).alias("bit")).distinct().repartition(F.floor(F.col("bit") / (1 << 18)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for b in batches:
            bit = b.column(0).to_numpy()
            for block in np.unique(bit >> 18):
                own.setdefault(int(block), np.zeros(1 << 18, bool))[bit[bit >> 18 == block] & ((1 << 18) - 1)] = True
        for block, x in own.items():
            yield pa.record_batch([pa.array([block], pa.int64()), pa.array([np.packbits(x).tobytes()], pa.binary())], ["block", "bits"])

    out = np.zeros(bits // 8, np.uint8)
    for block, x in rows.mapInArrow(run, "block long, bits binary").collect():  # at most FILTER_BITS / 8 bytes
        out[block << 15 : (block + 1) << 15] |= np.frombuffer(x, np.uint8)
    return out


def _signature(s: np.ndarray, width: int = BITS) -> bytes:
    bits = np.zeros(width, bool)
    bits[(s >> np.uint64(20)) % np.uint64(width)] = True
    return np.packbits(bits).tobytes()


def _width(n: int) -> int:
    """Bits for a set of n: a power of two, so that a signature folds to any shorter one, and n at least."""
    return max(BITS, 1 << (n - 1).bit_length())


def _matrix(column: pa.Array, rows: np.ndarray, size: int, to: int) -> np.ndarray:
    """Signatures of `size` bytes in these rows, folded to `to` bytes."""
    data, at = binary_view(column)
    own = data[at[rows][:, None] + np.arange(size)]
    return np.ascontiguousarray(np.bitwise_or.reduce(own.reshape(len(rows), size // to, to), 1)).view(np.uint64)


def _fetch_sets(docs: DataFrame, classes: DataFrame, k: int, text_col: str) -> DataFrame:
    """cls and own (the sorted set as bytes) of the classes wanted."""
    held = docs.sparkSession.sparkContext.broadcast(class_filter(classes, classes.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = held.value, set()
        for _, sets in _sets(batches, k):
            out = []
            for s in sets:
                c = _class(s)
                at = c % (len(bits) * 8)
                if bits[at >> 3] >> (7 - (at & 7)) & 1 and c not in seen:
                    seen.add(c)
                    out.append((c, s.tobytes()))
            if out:
                cls, own = zip(*out, strict=True)
                yield pa.record_batch([pa.array(cls, pa.int64()), pa.array(own, pa.binary())], ["cls", "own"])

    rows = docs.select(F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "cls long, own binary").join(classes, "cls", "left_semi").groupBy("cls").agg(F.first("own").alias("own"))


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = b.column(2), b.column(3)
            keep = pa.array([_linked(np.frombuffer(left[i].as_py(), np.uint64), np.frombuffer(right[i].as_py(), np.uint64), num, den) for i in range(len(b))], pa.bool_())
            yield pa.record_batch([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    one, two = sets.select(F.col("cls").alias("a"), F.col("own").alias("x")), sets.select(F.col("cls").alias("b"), F.col("own").alias("y"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _most(n, x: np.ndarray, m, y: np.ndarray) -> np.ndarray:
    """The largest possible overlap: each bit that only one signature has stands for a shingle at least that the other set lacks."""
    return np.minimum(n - np.bitwise_count(x & ~y).sum(-1, dtype=np.int64), m - np.bitwise_count(y & ~x).sum(-1, dtype=np.int64))


def _linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    if den * min(len(x), len(y)) < num * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return den * both >= num * (len(x) + len(y) - both)


def _small_pairs(num: int, den: int):
    """From rows key, cls, n, pos of tiles of bounded size: the pairs a > b that can reach the similarity if the tile's shingle is their first common one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches):
            key, cls, n, pos = (c.to_numpy() for c in b.columns)
            left = n - pos
            edge = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(b)]])
            found = [np.empty((2, 0), np.int64)]
            for i, j in _row_pairs(edge, np.zeros(len(b), np.int32)):
                ok = (den + num) * np.minimum(left[i], left[j]) >= num * (n[i] + n[j])
                found.append(np.stack([np.maximum(cls[i[ok]], cls[j[ok]]), np.minimum(cls[i[ok]], cls[j[ok]])]))
            pairs = np.unique(np.concatenate(found, 1), axis=1)
            yield pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return run


def _bounded(num: int, den: int):
    """Of rows a, b, n, sig, m, sig2 the pairs that bit counts do not rule out; bound is the similarity they allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b.column(2).to_numpy(), b.column(4).to_numpy()
            p, q = (np.diff(binary_view(b.column(i))[1]) for i in (3, 5))
            most = np.zeros(len(b), np.int64)
            for u, v in {*zip(p.tolist(), q.tolist(), strict=True)}:
                own = np.flatnonzero((p == u) & (q == v))
                x, y = _matrix(b.column(3), own, u, min(u, v)), _matrix(b.column(5), own, v, min(u, v))
                most[own] = _most(n[own], x, m[own], y)
            ok = pa.array(den * most >= num * (n + m - most))
            yield pa.record_batch([b.column(0).filter(ok), b.column(1).filter(ok), pa.array(most / (n + m - most)).filter(ok)], ["a", "b", "bound"])

    return run


#: Pairs of rows compared at a time.
AT_ONCE = 1 << 16


def _row_pairs(edge: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows i, j to compare in tiles that begin at `edge`: each with each, or side 0 with side 1 where both are there."""
    start, size = edge[:-1], np.diff(edge)
    cut = np.add.reduceat(side, start) > 0
    for g in np.unique(size[size > 1]).tolist():
        for lo, two in zip(*(x.tolist() for x in (start[size == g], cut[size == g])), strict=True) if g > 32 or cut[size == g].any() else ():
            one = lo + np.flatnonzero(side[lo : lo + g] == 0)
            for r, i in enumerate(one.tolist()):
                j = lo + np.flatnonzero(side[lo : lo + g] == 1) if two else one[r + 1 :]
                if len(j):
                    yield np.full(len(j), i), j
        if g <= 32 and not cut[size == g].any():
            i, j = np.triu_indices(g, 1)
            own = start[size == g]
            step = max(1, AT_ONCE // len(i))
            for k in range(0, len(own), step):
                lo = own[k : k + step, None]
                yield (lo + i).ravel(), (lo + j).ravel()


def _tile_pairs(num: int, den: int, best: bool):
    """Pairs of a tile that are in two components and that sizes and bit counts do not rule out.

    best: only the partner with the highest bound for each class, in both directions; bound is its similarity.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches):
            yield from emit(b)

    def emit(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tiles, side, cls, comp, n = (b.column(i).to_numpy() for i in range(5))
        sig = binary_view(b.column(5))[0].view(np.uint64).reshape(len(b), -1)
        edge = np.concatenate([[0], np.flatnonzero(tiles[1:] != tiles[:-1]) + 1, [len(b)]])
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i, j in _row_pairs(edge, side):
            ok = (comp[i] != comp[j]) & (den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j]))
            i, j = i[ok], j[ok]
            most = _most(n[i], sig[i], n[j], sig[j])
            ok = den * most >= num * (n[i] + n[j] - most)
            i, j, most = i[ok], j[ok], most[ok]
            if len(i):
                found.append((cls[i], cls[j], most / (n[i] + n[j] - most)))
        if not found:
            return
        a, c, bound = (np.concatenate(x) for x in zip(*found, strict=True))
        if best:
            a, c, bound = np.concatenate([a, c]), np.concatenate([c, a]), np.concatenate([bound, bound])
            order = np.lexsort((c, -bound, a))
        else:
            a, c = np.maximum(a, c), np.minimum(a, c)
            order = np.lexsort((c, a))
        a, c, bound = a[order], c[order], bound[order]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (not best) & (c[1:] != c[:-1])
        yield pa.record_batch([pa.array(a[first]), pa.array(c[first]), pa.array(bound[first])], ["a", "b", "bound"])

    return run


_PAIRS = "a long, b long, bound double"


def _tiles(rows: DataFrame, num: int, den: int) -> DataFrame:
    """tile, side, cls, comp, n, sig, from rows with g, the classes of their key: small keys are one tile; large ones are cut by size band and hash into blocks that meet in pairs."""
    small = rows.where(F.col("g") <= BLOCK).select(F.col("key").alias("tile"), F.lit(0).alias("side"), "cls", "comp", "n", "sig")
    band = F.floor(F.log("n") / np.log(den / num)).cast("int")
    large = rows.where(F.col("g") > BLOCK).withColumn("band", band)
    bands = large.groupBy("key", "band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    own = large.join(bands, ["key", "band"]).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    above = bands.select("key", (F.col("band") - 1).alias("band"), F.col("blocks").alias("up"))
    below = bands.select("key", (F.col("band") + 1).alias("band"), F.col("blocks").alias("down"))
    own = own.join(above, ["key", "band"], "left").join(below, ["key", "band"], "left")

    def pair(b1, k1, b2, k2, side):  # a tile is named by its two blocks, the lower first
        return F.struct(F.xxhash64("key", b1, k1, b2, k2).alias("tile"), F.lit(side).alias("side"))

    me, at = F.col("band"), F.col("block")
    meets = F.concat(
        F.array(pair(me, at, me, at, 0)),
        F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o > at), lambda o: pair(me, at, me, o, 0)),
        F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o < at), lambda o: pair(me, o, me, at, 1)),
        F.when(F.col("up").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("up") - 1), lambda o: pair(me, at, me + 1, o, 0))).otherwise(F.array()),
        F.when(F.col("down").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("down") - 1), lambda o: pair(me - 1, o, me, at, 1))).otherwise(F.array()),
    )
    cut = own.select(F.explode(meets).alias("t"), "cls", "comp", "n", "sig").select("t.tile", "t.side", "cls", "comp", "n", "sig")
    return small.unionAll(cut)


def _best(tiles: DataFrame, num: int, den: int) -> DataFrame:
    """a, b, bound: for each class a its partner of the highest bound."""
    found = tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tile_pairs(num, den, True), _PAIRS)
    top = found.groupBy("a").agg(F.max(F.struct("bound", "b")).alias("m"))
    return top.select("a", "m.b", "m.bound")


def _every(tiles: DataFrame, num: int, den: int) -> DataFrame:
    return tiles.repartition("tile").sortWithinPartitions("tile").mapInArrow(_tile_pairs(num, den, False), _PAIRS)


def _top(pairs: DataFrame) -> DataFrame:
    """a and b, a > b: for each class of the pairs the partner of the highest bound."""
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "bound"))
    top = both.groupBy("a").agg(F.max(F.struct("bound", "b")).alias("m"))
    return top.select(F.greatest("a", "m.b").alias("a"), F.least("a", "m.b").alias("b")).distinct()


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose classes are in two components."""
    one, two = comps.select(F.col("node").alias("a"), F.col("root").alias("x")), comps.select(F.col("node").alias("b"), F.col("root").alias("y"))
    placed = pairs.join(one, "a", "left").join(two, "b", "left")
    return placed.where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b", "bound")


def _still_open(left: DataFrame, comps: DataFrame) -> DataFrame:
    """The rows, with their components, of the keys that hold more than one component."""
    placed = left.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("root", "cls")).drop("root")
    open_ = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    return materialize(placed.join(open_, "key", "left_semi"), "open")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """id_col, n_shingles, component_id for every row of docs.

    Rows link when den * |A and B| >= num * |A or B| for their sets of distinct k-word shingles;
    component_id is the smallest id reachable. Defined cases: a text of fewer than k words has its
    whole word sequence as its only shingle; null and empty texts and texts of blanks have the empty
    set, link with nothing and keep their own id; rows without an id take part in linking, and their
    component has the smallest id that is not null, or null. Ids may repeat: every row is judged by
    its own text. An empty table gives an empty result.
    """
    found = materialize(profile(docs, k, id_col, text_col), "profile", TEXT_ROWS)
    frequent = _frequent(found)
    rows = found.where("kind = 0").select(F.col("a").alias(id_col), F.col("b").alias("cls"), F.col("n").alias("n_shingles"))
    prefixes = prefix_rows(docs, frequent, k, num, den, id_col, text_col)
    dealt = prefixes.repartition(F.when(F.col("hot"), F.col("cls")).otherwise(F.col("key"))).sortWithinPartitions("key", "cls")
    meet = materialize(dealt.mapInArrow(_shared_only, "key long, cls long, pos int"), "meet", 2 * TEXT_ROWS)

    # one row for each class first: copies of a text would all meet in one task of the join
    named = found.where("kind = 0").groupBy(F.col("b").alias("cls")).agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("wide").alias("wide"))
    marks = materialize(named.join(meet.select("cls").distinct(), "cls", "left_semi"), "signatures")
    wide, signed = marks.select("cls", "n", F.coalesce("wide", "sig").alias("sig")), marks.drop("wide")
    large = materialize(meet.groupBy("key").agg(F.count(F.lit(1)).alias("g")).where(F.col("g") > SMALL), "large-keys")
    slim = meet.join(large, "key", "left_anti").join(signed.select("cls", "n"), "cls").select("key", "cls", "n", "pos")
    small = slim.repartition("key").sortWithinPartitions("key").mapInArrow(_small_pairs(num, den), "a long, b long").distinct()
    small = small.join(wide.withColumnRenamed("cls", "a"), "a").join(wide.select(F.col("cls").alias("b"), F.col("n").alias("m"), F.col("sig").alias("sig2")), "b")
    small = materialize(small.select("a", "b", "n", "sig", "m", "sig2").mapInArrow(_bounded(num, den), _PAIRS), "pairs")
    big = materialize(meet.drop("pos").join(large, "key").join(signed, "cls"), "large")
    discard(meet, large)

    # each class with its most promising partner first; a class without one that the bounds allow is done
    first = materialize(_top(small.unionAll(_best(_tiles(big.withColumn("comp", F.col("cls")), num, den), num, den))), "pairs")
    near = materialize(first.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "near")
    sets = materialize(_fetch_sets(docs, near, k, text_col), "sets", TEXT_ROWS)
    all_big, big = big, materialize(big.join(near, "cls", "left_semi"), "large")
    links = [materialize(_verify(first, sets, num, den), "links")]
    discard(marks, near, all_big, first)
    comps = materialize(connected_components(links[0]), "components")
    for last in (False, True):  # partners in other components: once more the best of each class, then all
        apart = _apart(small, comps)
        open_ = _still_open(big, comps)
        tiles = _tiles(open_, num, den)
        pairs = apart.unionAll(_every(tiles, num, den)).select("a", "b").distinct() if last else _top(apart.unionAll(_best(tiles, num, den)))
        pairs = materialize(pairs, "pairs")
        more = materialize(_verify(pairs, sets, num, den), "links")
        discard(open_, pairs)
        if more.isEmpty():
            discard(more)
            continue
        links.append(more)
        before, comps = comps, materialize(connected_components(functools.reduce(DataFrame.unionAll, links)), "components")
        discard(before)
    discard(small, big, sets, *links)

    # tables on both sides of each join, so that Spark can split the copies of one text and a large component
    named = rows.join(comps.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    lowest = materialize(named.where("n_shingles > 0").groupBy("root").agg(F.min(id_col).alias("low")), "lowest")
    out = named.join(lowest, "root", "left")
    return out.select(id_col, "n_shingles", F.when(F.col("n_shingles") > 0, F.col("low")).otherwise(F.col(id_col)).alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with the row of the smallest id of each component; rows without an id stay, rows that repeat an id stay or go together."""
    out = jaccard_components(docs, id_col, text_col, **how)
    gone = out.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
