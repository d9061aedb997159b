"""Embedding whitening: principal components by a distributed singular value decomposition, each scaled to variance one.

Entries become whole numbers first (64 times the entry, rounded down, plus a million), so sums and deviations are exact.  The fit list
holds each distinct vector once: n vectors with sums S by dimension.  Its rows are centred exactly, as (n x - S) / n, and
Spark's MLlib decomposes the matrix of these rows; its Gramian is summed over the cluster, and only d x d numbers come to the
driver.  Singular values follow the divisor n: an eigenvalue of the covariance is the square of one over n.  The
total variance doesn't come from them, but from the exact deviations: their sum over the fit list, over n cubed.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped; vectors of different lengths are fitted apart,
each length with its own fit list; an empty vector has no components; components without variance (a singular value
under 1e-9 of the largest) can't be scaled and are left out, so one distinct vector gives no rows; rows that repeat an
id or a vector, and those of null id, are rows of their own; a deviation that no long holds is an error; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevein.llm.common import settle

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Singular values under this share of the largest are zero.
LEAST = 1e-9
_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_numbers(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, x of the rows whose vector is whole and finite."""
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.coalesce(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    x = F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    return kept.filter(fine).select("vec_id", F.size("v").alias("dim"), x.alias("x"))


def sums_by_dimension(fit: DataFrame, dim: int) -> list[int]:
    sums = [0] * dim
    for r in fit.select(F.posexplode("x").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("s")).collect():
        sums[r["k"]] = r["s"]
    return sums


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n x - S of rows of whole numbers, and the sum of its squares."""
    off = n * x - sums
    if len(off) and np.square(off.astype(np.float64)).sum(1).max() >= 2.0**63:
        raise OverflowError("a deviation is beyond a long")
    return off, np.square(off).sum(1)


def _matrix(b: pa.RecordBatch, dim: int) -> np.ndarray:
    """The rows of column x."""
    return b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, dim)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel()))


def row_matrix(rows: DataFrame, column: str, n: int, dim: int) -> RowMatrix:
    """A column of double arrays as a distributed matrix, without a way through Python."""
    own = rows.select(array_to_vector(F.col(column)).alias("v"))
    return RowMatrix(MLUtils.convertVectorColumnsFromML(own, "v"), n, dim)


def _whitened_length(rows: DataFrame, dim: int, components: int) -> DataFrame:
    """The result for vectors of one length."""
    fit = settle(rows.select("x").distinct())
    n = fit.count()
    sums = np.array(sums_by_dimension(fit, dim), np.int64)

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, square = deviations(_matrix(b, dim), n, sums)
            yield pa.RecordBatch.from_arrays([_lists(off / n), pa.array(square)], ["c", "deviation"])

    centred = settle(fit.mapInArrow(centre, "c array<double>, deviation long"))
    total = centred.agg(F.sum(F.col("deviation").cast("decimal(38,0)"))).first()[0]
    trace = float(Decimal(total) / Decimal(n) ** 3)
    if not total:
        return rows.sparkSession.createDataFrame([], _RESULT)
    # All components, so that the driver's dense solver takes the Gramian, not an iterative one that ends at a tolerance.
    found = row_matrix(centred, "c", n, dim).computeSVD(dim, computeU=False, rCond=LEAST)
    sigma = np.array(found.s.toArray())[:components]
    v = found.V.toArray()[:, : len(sigma)]
    scale = sigma / np.sqrt(n)  # the root of an eigenvalue of the covariance
    explained = scale**2 / trace

    def projected(off: np.ndarray) -> np.ndarray:
        return (off / n) @ v / scale

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([_lists(projected(n * _matrix(b, dim) - sums))], ["w"])

    # The covariance of what comes out, over the fit list again: exact means first, then products of centred entries.
    out = settle(fit.mapInArrow(whiten, "w array<double>"))
    k = len(sigma)
    mean = [0.0] * k
    for r in out.select(F.posexplode("w").alias("k", "w")).groupBy("k").agg(F.avg("w").alias("m")).collect():
        mean[r["k"]] = r["m"]
    apart = out.select(F.zip_with("w", F.array(*map(F.lit, mean)), lambda a, b: a - b).alias("w"))
    covariance = row_matrix(apart, "w", n, k).computeGramianMatrix().toArray() / n
    error = float(np.abs(covariance - np.eye(k)).max())

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, square = deviations(_matrix(b, dim), n, sums)
            m = b.num_rows
            ids = b.column("vec_id").take(pa.array(np.repeat(np.arange(m), k)))
            columns = [ids, np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, n), np.repeat(square, k), projected(off).ravel(), np.tile(explained, m), np.full(m * k, error)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(result, _RESULT)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every whole row and component."""
    rows = settle(whole_numbers(vectors))
    out = rows.sparkSession.createDataFrame([], _RESULT)
    for r in rows.filter("dim > 0").groupBy("dim").count().orderBy("dim").collect():
        out = out.unionByName(_whitened_length(rows.filter(F.col("dim") == r["dim"]), r["dim"], components))
    return out
