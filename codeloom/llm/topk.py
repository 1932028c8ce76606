"""Exact top-k by inner product, by aggregating sorted lists without random access."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors whose lists are sorted and read together.
BLOCK = 4096
#: Queries worked on together.
TILE = 1024
#: Bytes of query vectors that are collected and broadcast at once; more queries take several passes.
SLICE_BYTES = 16 << 20
#: Depths, as shares of a list, at which bounds are compared; at the end of all lists both are the score.
DEPTHS = (0.25, 0.5, 0.75, 1.0)
#: Stands for no score.
NONE = np.iinfo(np.int64).min


class Best:
    """The k best of each query so far: score down, then id up."""

    def __init__(self, n: int, k: int):
        self.score = np.full((n, k), NONE)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.k = k

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Take in (query, id, score) triples, in any order."""
        order = np.lexsort((ids, ~score, query))
        q, i, s = query[order], ids[order], score[order]
        first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
        begin = np.flatnonzero(first)
        rank = np.arange(len(q)) - np.repeat(begin, np.diff(np.r_[begin, len(q)]))
        keep = rank < self.k
        q, i, s, rank = q[keep], i[keep], s[keep], rank[keep]
        rows = q[rank == 0]
        new_s, new_i = np.full((len(rows), self.k), NONE), np.full((len(rows), self.k), np.iinfo(np.int64).max)
        at = np.searchsorted(rows, q)
        new_s[at, rank], new_i[at, rank] = s, i
        all_s, all_i = np.hstack([self.score[rows], new_s]), np.hstack([self.id[rows], new_i])
        pick = np.lexsort((all_i, ~all_s), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(all_s, pick, 1), np.take_along_axis(all_i, pick, 1)


def scores_of(q: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Integer inner products of the rows of q and x, row by row; `most` bounds their size."""
    if most < 1 << 63:
        return np.einsum("nd,nd->n", q, x)
    exact = [sum(a * b for a, b in zip(v, w, strict=True)) for v, w in zip(q.tolist(), x.tolist(), strict=True)]
    if any(abs(s) >= 1 << 63 for s in exact):
        raise ArithmeticError("an inner product doesn't fit in 64 bits")
    return np.array(exact, np.int64)


def sorted_lists(x: np.ndarray) -> np.ndarray:
    """Each component's list of a block's vectors: its values, rising."""
    return np.sort(x, axis=0)


def search_block(best: Best, at: int, q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, lists: np.ndarray | None = None) -> int:
    """Take a block of vectors into the best of the queries at .. at + len(q).

    Each component has a list of the block's vectors sorted by it. For a query, a list is read
    from the top where the query's component is positive and from the bottom where it is
    negative. At each depth a vector's upper bound takes the components read so far as they are
    and the others as the last value read; its lower bound takes the others as the list's last
    value. A vector is out for a query once its upper bound is below the k-th best lower bound,
    or the k-th best score of earlier blocks. Reading stops for a query once no more than k
    vectors are left, as no other can qualify then, and at the lists' ends at last; no score is
    looked up on the way, and those of what is left are then resolved. lists are sorted_lists(x).
    Returns how many (query, depth) pairs were read.
    """
    n, k = len(x), best.k
    most = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * x.shape[1]
    kind = np.float32 if 4 * most < 1 << 24 else np.float64
    slack = 0.0 if 4 * most < 1 << 53 else most * 2.0**-46  # what rounding may add to a bound
    whole_q, whole_x = q, x
    lists = (sorted_lists(x) if lists is None else lists).astype(kind)
    q, x = q.astype(kind), x.astype(kind)
    low, high = lists[0], lists[-1]
    pos, neg = np.maximum(q, 0), np.minimum(q, 0)
    kth = best.score[at : at + len(q), -1]
    least = np.where(kth == NONE, -np.inf, kth.astype(np.float64))
    live = q_ids[:, None] != x_ids[None, :]
    rows, read = np.arange(len(q)), 0  # queries that still read
    for depth in DEPTHS:
        rows = rows[np.count_nonzero(live[rows], axis=1) > k]
        if not len(rows):
            break
        read += len(rows)
        t = max(1, math.ceil(depth * n))
        top, bottom = lists[n - t], lists[t - 1]
        from_top, from_bottom = x >= top, x <= bottom  # read so far, with all equals of the last value
        up, down = pos[rows], neg[rows]
        lower = up @ np.where(from_top, x - low, 0).T
        lower += down @ np.where(from_bottom, x - high, 0).T
        lower += (up @ low + down @ high)[:, None]
        lower[~live[rows]] = -np.inf
        least[rows] = np.maximum(least[rows], np.partition(lower, n - k, axis=1)[:, n - k])
        upper = up @ np.where(from_top, x - top, 0).T
        upper += down @ np.where(from_bottom, x - bottom, 0).T
        upper += (up @ top + down @ bottom)[:, None]
        live[rows] &= upper >= (least[rows] - 2 * slack)[:, None]
    a, b = np.nonzero(live)
    step = max(1, (1 << 21) // max(1, x.shape[1]))
    for i in range(0, len(a), step):
        qi, xi = a[i : i + step], b[i : i + step]
        best.add(qi + at, x_ids[xi], scores_of(whole_q[qi], whole_x[xi], most))
    return read


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Integer vectors as rows; a shorter vector is filled with zeros, which add nothing to a product."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    lens = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(col), dim), np.int64)
    row = np.repeat(np.arange(len(col)), lens)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    inside = place < dim
    out[row[inside], place[inside]] = flat[inside]
    return out


def top_k(vectors: DataFrame, k: int = 5, is_query=None, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k highest integer inner products of each query row with all other rows.

    Components become floor(scale * x). Queries are the rows where the condition is_query holds
    (by default, ids divisible by 50); they are broadcast in slices of SLICE_BYTES, and every
    slice meets all vectors in blocks, where they lie: no vector is shuffled. A task emits its k
    best of each query, and a window picks the k best of those.

    Defined cases: vectors that are null or hold null or non-finite components take no part, as
    queries or candidates; all rows with the query's own id are its own; equal query rows count
    once; a repeated candidate row counts as often as it stands; of vectors of unequal length
    the shorter ends in zeros; ties go to the smaller id; fewer than k candidates give fewer
    rows, no rows none; null ids take no part. Scores are exact; one beyond 64 bits raises an
    error, and components of 2 ** 63 / scale or more count as that. Other columns don't matter.

    Returns query_id, rank, vec_id, score.
    """
    spark = vectors.sparkSession
    is_query = F.col(vec_id) % 50 == 0 if is_query is None else is_query
    x = F.col(embedding)
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    base = vectors.where(fine & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double"))).alias("v"), is_query.alias("is_query"))
    queries = base.where("is_query").select("id", "v").distinct()
    stat = queries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    if not stat.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    slices = math.ceil(stat.n * stat.dim * 8 / SLICE_BYTES) or 1
    found = None
    for s in range(slices):
        some = queries if slices == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(slices)) == s)
        part = _search(base, some.toArrow(), int(stat.dim), k).withColumn("slice", F.lit(s))
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("slice", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(base: DataFrame, queries: pa.Table, dim: int, k: int) -> DataFrame:
    q_ids = queries.column("id").to_numpy()
    q = _matrix(queries.column("v"), dim)
    shared = base.sparkSession.sparkContext.broadcast((q_ids, q))

    def run(batches):
        ids, q = shared.value
        best = Best(len(ids), k)

        def take(held):
            x_ids = np.concatenate([b.column("id").to_numpy() for b in held])
            x = np.vstack([_matrix(b.column("v"), dim) for b in held])
            lists = sorted_lists(x)
            for at in range(0, len(ids), TILE):
                search_block(best, at, q[at : at + TILE], ids[at : at + TILE], x, x_ids, lists)

        held, n = [], 0
        for b in batches:
            for i in range(0, b.num_rows, BLOCK):
                piece = b.slice(i, BLOCK)
                if n + piece.num_rows > BLOCK:
                    take(held)
                    held, n = [], 0
                held.append(piece)
                n += piece.num_rows
        if n:
            take(held)
        a, r = np.nonzero(best.score != NONE)
        for i in range(0, len(a), 1 << 16):
            aa, rr = a[i : i + (1 << 16)], r[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(aa.astype(np.int32)), pa.array(ids[aa]), pa.array(best.id[aa, rr]), pa.array(best.score[aa, rr])], names=["q", "query_id", "vec_id", "score"])

    return base.select("id", "v").mapInArrow(run, "q int, query_id long, vec_id long, score long")
