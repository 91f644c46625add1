"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists.

Queries and candidates are dealt into blocks of bounded size, and each pair of blocks is one group.
There the algorithm reads the lists of all dimensions from their best ends, deeper by steps, and scores
each new vector in full. It stops for a query when no vector unseen so far can beat its k-th score:
the bound is the best inner product of any vector that stays behind the last values read and is no
longer than the longest vector of the block. Where the bound does not fall that far, the lists are
read to their ends. The best k of each block are merged by query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES, QUERIES = 16_384, 2_048
#: Entries of each list read in the first step of the search; each step reads four times more.
STEP = 8
#: Queries whose new vectors are scored in one product.
TOGETHER = 64
#: Multipliers at which the bound is tried; each gives a valid bound, the smallest one counts.
_TRIES = np.array([1.0, 1.2, 1.5, 2.0, 3.0, 5.0, 10.0, 30.0])


def whole_vectors(rows: DataFrame, id_col: str, vec_col: str, scale: int = 64) -> DataFrame:
    """id and vec (array of long): floor(scale * x) of every component.

    Rows take no part whose id or vector is null, or whose vector is empty or holds a null or
    non-finite component. Rows that repeat an id count once, with the smallest vector.
    """
    sound = F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & F.forall(vec_col, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return (
        rows.where(F.col(id_col).isNotNull() & sound)
        .select(F.col(id_col).alias("id"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale)).alias("vec"))
        .groupBy("id")
        .agg(F.min("vec").alias("vec"))
    )


def exact_top_k(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates of highest inner product for every query.

    vectors: id and vec (array of long); is_query: a condition on id. Every row but the query itself
    is a candidate, among vectors of the query's length. Ties go to the smaller id; a query with
    fewer candidates returns all. Vectors so large that a score could pass 64 bits are an error. An
    empty table gives no rows.
    """
    n, n_queries = vectors.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    cb, qb = max(1, -(-n // CANDIDATES)), max(1, -(-n_queries // QUERIES))

    def every(blocks: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))

    vectors = vectors.select("id", "vec", F.size("vec").alias("dims"))
    left = vectors.where(is_query).select("dims", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(qb).cast("long")).alias("q"), every(cb).alias("c"), "id", "vec")
    right = vectors.select("dims", every(qb).alias("q"), F.pmod(F.xxhash64("id"), F.lit(cb).cast("long")).alias("c"), "id", "vec")

    def search(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found = block_top_k(*_matrix(queries), *_matrix(candidates), k) if queries.num_rows and candidates.num_rows else ()
        got = [(a, b, s) for a, ids, scores in found for b, s in zip(ids.tolist(), scores.tolist(), strict=True)]
        cols = list(zip(*got, strict=True)) if got else [[], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), cols, strict=True)})

    keys = ("dims", "q", "c")
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    t = t.combine_chunks()
    vec = t.column("vec").chunk(0)
    return t.column("id").to_numpy(), vec.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)


def block_top_k(qid: np.ndarray, queries: np.ndarray, cid: np.ndarray, x: np.ndarray, k: int, read: list[int] | None = None):
    """(query id, candidate ids, scores) of each query in one block, best first. read: gets the list entries read for each query."""
    by_id = np.argsort(cid, kind="stable")
    cid, x = cid[by_id], x[by_id]
    kind = _exact_type(queries, x)
    block = _Block(x, kind)
    own = np.searchsorted(cid, qid)
    own = np.where(cid[np.minimum(own, len(cid) - 1)] == qid, own, -1)
    for lo in range(0, len(qid), TOGETHER):
        some = slice(lo, lo + TOGETHER)
        for q, (at, scores, entries) in zip(qid[some].tolist(), block.search(queries[some], own[some], k), strict=True):
            if read is not None:
                read.append(entries)
            yield q, *_best(at, scores, cid, k)


def _exact_type(q: np.ndarray, x: np.ndarray):
    """The fastest type in which no sum of products can be rounded."""
    most = float(np.abs(q.astype(float)).max(initial=1)) * float(np.abs(x.astype(float)).max(initial=1)) * x.shape[1]
    if most >= 2**63:
        raise OverflowError("vectors too large for exact scores of 64 bits")
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def _best(at: np.ndarray, scores: np.ndarray, cid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of candidate places `at` (in the order of id), ties to the smaller id."""
    if len(at) > k:
        bar = np.partition(scores, len(at) - k)[len(at) - k]
        above, equal = np.flatnonzero(scores > bar), np.flatnonzero(scores == bar)
        pick = np.concatenate([above, equal[: k - len(above)]])
        at, scores = at[pick], scores[pick]
    order = np.lexsort((at, -scores))
    return cid[at[order]], scores[order].astype(np.int64)


class _Block:
    """The candidates of one block and, for each dimension, the list of them by rising value."""

    def __init__(self, x: np.ndarray, kind):
        self.wide = x.astype(kind)
        self.lists = np.argsort(x, 0, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(x, self.lists, 0).astype(np.float64)
        self.longest = float(np.sqrt((x.astype(np.float64) ** 2).sum(1).max()))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """Places and scores of the vectors seen for each query (k best among them), and the list entries read. own: the query's place, or -1."""
        n, m = len(self.wide), len(queries)
        sign, qw = np.sign(queries), queries.astype(self.wide.dtype)
        seen, scored = np.zeros((m, n), bool), np.zeros(n, bool)
        scores = np.zeros((m, n), self.wide.dtype)
        out: list = [None] * m
        on = np.arange(m)
        depth, step = 0, STEP
        while len(on):
            end = min(n, depth + step)
            for i in on.tolist():
                up, down = np.flatnonzero(sign[i] > 0), np.flatnonzero(sign[i] < 0)
                seen[i, self.lists[n - end : n - depth][:, up]] = True
                seen[i, self.lists[depth:end][:, down]] = True
                if not len(up) + len(down):  # a query of zeros has no lists: all scores are equal
                    seen[i] = True
            new = np.flatnonzero(seen[on].any(0) & ~scored)
            scored[new] = True
            if len(new) * 2 > n:  # a slice is cheaper than picking most rows
                scores[on] = qw[on] @ self.wide.T
            else:
                scores[np.ix_(on, new)] = qw[on] @ self.wide[new].T
            bound = self._bound(queries[on].astype(np.float64), sign[on], n - end, end - 1)
            left = []
            for r, i in enumerate(on.tolist()):
                at = np.flatnonzero(seen[i])
                at = at[at != own[i]]
                s = scores[i, at]
                if end < n and np.count_nonzero(seen[i]) < n and (len(at) < k or np.partition(s, len(at) - k)[len(at) - k] <= bound[r]):
                    left.append(i)
                else:
                    out[i] = (at, s, end * int(np.count_nonzero(sign[i])))
            on = np.array(left, np.int64)
            depth, step = end, 4 * step
        return out

    def _bound(self, q: np.ndarray, sign: np.ndarray, top: int, bottom: int) -> np.ndarray:
        """For each query no less than the score of any vector unseen: one whose values lie behind those read last.

        With q and the values turned so that q >= 0, an unseen y has y <= t in every dimension, and its
        length is L at most. For any c > 0, q.y <= sum(q * z - z * z / 2c) + L * L / 2c, where z is
        min(c * q, t) in each dimension; the plain sum of q * t is the bound without a length.
        """
        t = np.where(sign > 0, self.values[top], np.where(sign < 0, -self.values[bottom], 0.0))
        q = np.abs(q)
        best = (q * t).sum(1)
        length = np.sqrt((q * q).sum(1))
        for f in _TRIES:
            c = (f * self.longest / np.maximum(length, 1e-9))[:, None]
            if self.longest:
                z = np.where(sign == 0, 0.0, np.minimum(c * q, t))
                best = np.minimum(best, (q * z - z * z / (2 * c)).sum(1) + (self.longest**2 / (2 * c))[:, 0])
        return best + np.abs(best) * 1e-9 + 1e-6
