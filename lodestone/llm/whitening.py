"""Whitening of embeddings from a polarised covariance.

Entries c become whole numbers x = floor(SCALE * c) + OFFSET. The fit list holds each distinct x-vector once: n of them,
with sums S by dimension. Every x is centred by the whole number m = floor(S / n) of its dimension to y = x - m, whose
sums are r = S - n * m with 0 <= r < n. For each dimension i, and for each pair i < j of dimensions, the squares y_i^2 and
(y_i + y_j)^2 are summed over the fit list, as whole numbers of any size. With P the sum of squares and R the sum of a
dimension or a pair, n * P - R^2 is n^2 times its variance exactly; and since

    Var(i + j) = Var(i) + Var(j) + 2 * Cov(i, j),

half of what a pair's variance has above those of its dimensions is the covariance. These are whole numbers until one
division gives the matrix of doubles that eigh takes apart.

The fit list is found by one distinct, which aggregates before it shuffles, and is written to the shared folder; two
passes read it, for S and for the sums of squares, of which each task returns one row for each dimension or pair. A third
pass gives the covariance of what is whitened. The driver holds d * (d + 1) / 2 sums of d dimensions, and their matrix;
these don't grow with the rows.

Vectors take no part that are null, are empty, or hold null or non-finite entries or entries of 2^50 or more in size
(which x couldn't hold). All vectors are to have one length; if not, those of the most frequent length (the greater of
two) take part. Rows that repeat are answered each, null ids too. Components whose eigenvalue is no more than d * 2^-50 of
the greatest are noise of rounding and left out, so that there are no more than the fit list's rank: an empty table, or
one distinct vector, has no rows. deviation is null where it would not fit 64 bits. The fit's jobs run when whitened() is
called, and nothing but the id and the vector is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.tasks import written

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Entries below this, in size, have an x.
LARGEST = float(1 << 50)
#: Sums go to the shuffle as LIMBS limbs of LIMB bits, each a 64-bit number, so that no count of tasks overflows them.
LIMB, LIMBS = 40, 5
#: Vectors that a task handles at once.
ROWS = 2048
NOISE = 2.0**-50


def taking_part(vector: Column) -> Column:
    """Whether a vector has entries, all of them finite and not too large."""
    fine = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False)))  # NaN is above all in Spark
    return F.coalesce(fine & (F.size(vector) > 0), F.lit(False))


def whole(vector: Column) -> Column:
    """The vector's x."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(OFFSET).cast("long"))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _exact(x: np.ndarray, most: int) -> np.ndarray:
    """64-bit numbers, or Python's where values may grow to `most`."""
    return x if most < 1 << 62 else x.astype(object)


def _limbs(kinds: list[int], sums: list[int]) -> pa.RecordBatch:
    """Whole numbers as limbs; the sign goes with each of them."""
    cut = [[(1 if s >= 0 else -1) * (abs(s) >> (LIMB * k) & ((1 << LIMB) - 1)) for s in sums] for k in range(LIMBS)]
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), *(pa.array(c, pa.int64()) for c in cut)], names=["kind", *(f"l{k}" for k in range(LIMBS))])


_SUMS = "kind int, " + ", ".join(f"l{k} long" for k in range(LIMBS))


def _summed(x: DataFrame, work) -> dict[int, int]:
    """Totals of the whole numbers, by kind, that work(matrix) returns for up to ROWS vectors."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in _batches(batches):
            own = work(_matrix(batch.column(0)))
            total = own if total is None else total + own
        if total is not None:
            yield _limbs(list(range(len(total))), total.tolist())

    rows = x.mapInArrow(each, _SUMS).groupBy("kind").agg(*(F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS))).collect()
    return {r.kind: sum(r[f"l{k}"] << (LIMB * k) for k in range(LIMBS)) for r in rows}


def dimension_sums(m: np.ndarray) -> np.ndarray:
    """The number of vectors, then the sum of each dimension, as Python's whole numbers."""
    most = int(np.abs(m).max(initial=0)) * len(m)
    return np.concatenate([np.array([len(m)], object), _exact(m, most).sum(0).astype(object)])


def square_sums(y: np.ndarray) -> np.ndarray:
    """Sums of y_i^2 for each i, then of (y_i + y_j)^2 for each i < j, as Python's whole numbers."""
    y = _exact(y, (2 * int(np.abs(y).max(initial=0))) ** 2 * max(1, len(y)))
    parts = [(y * y).sum(0)]
    for i in range(y.shape[1] - 1):
        both = y[:, i + 1 :] + y[:, i : i + 1]
        both *= both
        parts.append(both.sum(0))
    return np.concatenate([p.astype(object) for p in parts])


@dataclass
class Fit:
    """n distinct x-vectors; by dimension their sums S, whole centres and what sums of y leave; and the components: unit
    vectors as rows, eigenvalues, and shares of the trace."""

    n: int
    sums: list[int]
    centre: list[int]
    rest: list[int]
    vectors: np.ndarray
    values: np.ndarray
    shares: np.ndarray

    def whitened(self, x: np.ndarray) -> np.ndarray:
        y = (x - np.array(self.centre, np.int64)).astype(np.float64)
        y -= np.array([r / self.n for r in self.rest])
        return (y @ self.vectors.T) / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n * x - S)^2 of each vector; null where 64 bits don't hold it."""
        y = x - np.array(self.centre, np.int64)
        most = int(np.abs(y).max(initial=0)) * self.n + max(self.rest, default=0)
        y = _exact(y, most * most * y.shape[1])
        z = y * self.n - np.array(self.rest, y.dtype)
        return [v if v < 1 << 63 else None for v in (z * z).sum(1).tolist()]


def covariance(n: int, rest: list[int], squares: list[int]) -> np.ndarray:
    """The covariance, divisor n, from the sums of y and of squares of dimensions and pairs."""
    d = len(rest)
    own = [n * squares[i] - rest[i] ** 2 for i in range(d)]
    out = np.zeros((d, d))
    at = d
    for i in range(d):
        out[i, i] = own[i] / n**2
        for j in range(i + 1, d):
            both = n * squares[at] - (rest[i] + rest[j]) ** 2
            out[i, j] = out[j, i] = (both - own[i] - own[j]) // 2 / n**2  # an even number; Python rounds one quotient of whole numbers once
            at += 1
    return out


def fit(x: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """From distinct x-vectors of one length, in the column x; none if there are none or they don't vary."""
    x = x.select("x")
    sums = _summed(x, dimension_sums)
    if not sums:
        return None
    n, d = sums[0], len(sums) - 1
    sums = [sums[k + 1] for k in range(d)]
    centre = [s // n for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre)]
    centres = np.array(centre, np.int64)
    squares = _summed(x, lambda m: square_sums(m - centres))
    matrix = covariance(n, rest, [squares[k] for k in range(d * (d + 1) // 2)])
    values, vectors = np.linalg.eigh(matrix)
    falling = np.argsort(-values, kind="stable")[:components]
    falling = falling[values[falling] > max(0.0, values.max() * d * NOISE)]
    if not len(falling):
        return None
    return Fit(n, sums, centre, rest, np.ascontiguousarray(vectors[:, falling].T), values[falling], values[falling] / np.trace(matrix))


def identity_error(x: DataFrame, found: Fit) -> float:
    """The largest entry, in size, of the covariance of the fit list's whitened rows minus the identity."""
    k = len(found.values)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in _batches(batches):
            w = found.whitened(_matrix(batch.column(0)))
            first += w.sum(0)
            second += w.T @ w
        both = np.concatenate([first, second.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(both)), pa.int32()), pa.array(both)], names=["at", "total"])

    rows = x.select("x").mapInArrow(each, "at int, total double").groupBy("at").agg(F.sum("total").alias("total")).collect()
    flat = np.zeros(k + k * k)
    for r in rows:
        flat[r["at"]] = r.total / found.n
    mean, second = flat[:k], flat[k:].reshape(k, k)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """For each vector that takes part and each component (from 1): the id, component, n, deviation, whitened, explained and
    identity_error."""
    spark = rows.sparkSession
    schema = T.StructType([
        rows.schema[id_col], T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
    ])
    vector = F.col(vector_col)
    own = rows.select(id_col, vector_col).where(taking_part(vector)).select(F.col(id_col), whole(vector).alias("x"))
    lengths = own.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    own = own.where(F.size("x") == lengths[0].d)
    distinct = written(own.select("x").distinct())
    found = fit(distinct, components)
    if found is None:
        return spark.createDataFrame([], schema)
    error, k = identity_error(distinct, found), len(found.values)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            x = _matrix(batch.column(1))
            n = len(x)
            of = np.repeat(np.arange(n), k)
            deviation = pa.array(found.deviations(x), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(of)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, found.n)), deviation.take(pa.array(of)),
                    pa.array(found.whitened(x).ravel()), pa.array(np.tile(found.shares, n)), pa.array(np.full(n * k, error)),
                ],
                names=schema.names,
            )

    return own.mapInArrow(each, schema)
