"""Embeddings whitened along their first principal components, by a two-pass covariance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy, tree_merged, written

#: Entries of vectors that a step works on at once.
BLOCK_VALUES = 1 << 20
#: Whole numbers below this are exact as doubles, and their sums of few as 64-bit integers.
SAFE = 1 << 52


def matrix(col: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    """The vectors of a task in matrices of at most BLOCK_VALUES entries, or of a batch."""
    held, n = [], 0
    for b in batches:
        held.append(matrix(b.column("x")))
        n += held[-1].size
        if n >= BLOCK_VALUES:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def largest(x: np.ndarray) -> int:
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


class Centre:
    """The mean S / n as whole numbers and a rest, so that x less the mean keeps its digits far from zero."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = [s // n for s in sums]
        self.rest = np.array([s % n / n for s in sums])

    def less(self, x: np.ndarray) -> np.ndarray:
        """x - S / n in doubles."""
        if max(largest(x), max(map(abs, self.whole))) < 1 << 62:
            return (x - np.array(self.whole, np.int64)).astype(np.float64) - self.rest
        return np.array([[v - w for v, w in zip(row, self.whole, strict=True)] for row in x.tolist()], np.float64).reshape(x.shape) - self.rest

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n x - S)^2 of each row, exact; None where it doesn't fit in 64 bits."""
        most = self.n * largest(x) + max(map(abs, self.sums))
        if most < 1 << 62 and most * most * x.shape[1] < 1 << 63:
            d = x * self.n - np.array(self.sums, np.int64)
            return (d * d).sum(axis=1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [d if d < 1 << 63 else None for d in exact]


class Whitening:
    """What a fit gives: the centre, the components as columns, their eigenvalues and share of the trace, and the measured error."""

    def __init__(self, centre: Centre, values: np.ndarray, vectors: np.ndarray, trace: float, least: float):
        self.centre, self.values, self.vectors = centre, values, vectors
        self.live = values > least
        self.explained = np.where(values > 0, values, 0.0) / trace if trace > 0 else np.zeros(len(values))
        self.error: float | None = None

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates, NaN for components without variance."""
        out = np.full((len(x), len(self.values)), np.nan)
        out[:, self.live] = self.centre.less(x) @ self.vectors[:, self.live] / np.sqrt(self.values[self.live])
        return out


def integer_vectors(df: DataFrame, scale: int, embedding: str, **kept: str) -> DataFrame:
    """Rows with whole, finite vectors as x = floor(scale * c), all as long as the longest, and the columns `kept` (new name = expression)."""
    e = F.col(embedding)
    fine = e.isNotNull() & F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    base = df.where(fine).select(*(F.expr(v).alias(k) for k, v in kept.items()), F.transform(e, lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))).alias("x"))
    size = base.agg(F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).first()
    if size.most is not None and size.least < size.most:
        base = base.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(size.most) - F.size("x"))))
    return base


def _sums(batches: Iterator[pa.RecordBatch], dim: int):
    """(n, sums) in whole numbers of any size."""
    n, total = 0, [0] * dim
    for x in blocks(batches, dim):
        small = largest(x) * len(x) < 1 << 62
        got = x.sum(axis=0).tolist() if small else [sum(c) for c in zip(*x.tolist(), strict=True)]
        total = [a + b for a, b in zip(total, got, strict=True)]
        n += len(x)
    return (n, total) if n else None


def _joined(a, b):
    """Merge (n, mean, centred outer products) of two parts, centred at the mean of both."""
    (n, m, c), (k, o, d) = a, b
    gap = o - m
    return n + k, m + gap * (k / (n + k)), c + d + np.outer(gap, gap) * (n * k / (n + k))


def fit(vectors: DataFrame, components: int = 4) -> Whitening | None:
    """The whitening of the different vectors among x of integer_vectors; None without vectors or entries.

    They are written once. The first pass sums them in whole numbers, which gives the mean; the
    second sums outer products of what is centred at it, block by block; tasks' matrices are
    merged in a tree. The driver holds a matrix of dim x dim and takes its eigenvectors. A third
    pass measures the covariance of the whitened rows, each block centred before multiplying.
    """
    one = written(vectors.select("x").distinct(), "fit-list")
    small_batches(vectors.sparkSession)
    first = one.select(F.size("x").alias("dim")).first()
    dim = first.dim if first else 0
    if not dim:
        return None
    centre = Centre(*tree_merged(one, lambda batches: _sums(batches, dim), lambda a, b: (a[0] + b[0], [v + w for v, w in zip(a[1], b[1], strict=True)])))

    def products(batches):
        out = np.zeros((dim, dim))
        for x in blocks(batches, dim):
            c = centre.less(x)
            out += c.T @ c
        return out

    v = tree_merged(one, products, np.add) / centre.n
    values, columns = np.linalg.eigh((v + v.T) / 2)
    pick = np.argsort(-values, kind="stable")[:components]
    w = Whitening(centre, values[pick], columns[:, pick], float(np.trace(v)), max(float(values.max()), 0.0) * dim * np.finfo(np.float64).eps)
    shared = vectors.sparkSession.sparkContext.broadcast(w)

    def whitened(batches):
        out = None
        for x in blocks(batches, dim):
            p = shared.value.project(x)[:, shared.value.live]
            mean = p.mean(axis=0)
            part = (len(p), mean, (p - mean).T @ (p - mean))
            out = part if out is None else _joined(out, part)
        return out

    n, _, c = tree_merged(one, whitened, _joined)
    w.error = float(np.abs(c / n - np.eye(len(c))).max()) if len(c) else None
    return w


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Whitened coordinates of every vector along the first components of the different vectors' covariance.

    Entries become x = floor(scale * c). The fit list holds each different x once; only it, by a
    shuffle with partial aggregation, and matrices of dim x dim are moved. Rows are projected
    where they lie with a broadcast of dim x components doubles.

    Defined cases: rows whose vector is null or holds null or non-finite entries are dropped; null
    and repeated ids stay, row by row; of vectors of unequal length the shorter end in zeros;
    there are as many components as entries, if these are fewer; a component without variance
    (one vector, or all equal along it) has a null coordinate, explains 0 and is left out of
    identity_error, which is null if there is no other; a deviation beyond 64 bits is null; entries
    of 2 ** 63 / scale or more count as that; empty tables and empty vectors give no rows; other
    columns don't matter. dim x dim doubles must fit in a task and on the driver.

    Returns vec_id, component (from 1), n, deviation, whitened, explained, identity_error.
    """
    spark = vectors.sparkSession
    base = integer_vectors(vectors, scale, embedding, vec_id=f"`{vec_id}`")
    kind = base.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    w = fit(base, components)
    if w is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(w)

    def run(batches):
        w = shared.value
        k = len(w.values)
        for batch in batches:
            step = max(1, BLOCK_VALUES // len(w.centre.sums))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x, m = matrix(part.column("x")), part.num_rows
                rows = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, w.centre.n, np.int64)), pa.array(w.centre.deviation(x), pa.int64()).take(pa.array(rows)),
                        pa.array(w.project(x).ravel(), from_pandas=True), pa.array(np.tile(w.explained, m)), pa.array([w.error] * (m * k), pa.float64()),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    small_batches(spark)
    return base.mapInArrow(tidy(run), schema)
