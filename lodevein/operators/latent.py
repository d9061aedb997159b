"""Latent topics of a sparse relation: its leading singular vectors by subspace iteration over joins.

The relation stays in long form (node, topic, weight).  A round joins it with a short vector for each topic, sums by node, and back; centring is a
correction of rank one, so zeros are never written.  The driver holds squares of the number of vectors, whatever the numbers of nodes and topics are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodevein.operators.model import _cut


@dataclass
class Topics:
    """Singular values in falling order; nodes(node, topics), the projections of centred rows; loadings(topic, loading) of unit axes."""

    values: list[float]
    nodes: DataFrame
    loadings: DataFrame


def _normal(topic: Column, i: int, seed: int) -> Column:
    """A normal number that hangs on the topic alone, by the transform of two uniform ones."""
    unit = lambda j: (F.pmod(F.xxhash64(topic, F.lit(seed), F.lit(2 * i + j)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return F.sqrt(-2 * F.log(unit(0))) * F.cos(2 * math.pi * unit(1))


def _gram(vectors: DataFrame, d: int) -> np.ndarray:
    """Sum of v v' over vectors(v): a partial sum for each task, added up by cell."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d, dtype=np.int32)), pa.array(total.reshape(-1))], names=["cell", "x"])

    out = np.zeros(d * d)
    for r in vectors.select("v").mapInArrow(part, "cell int, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect():  # d * d rows
        out[r["cell"]] = r["x"]
    return out.reshape(d, d)


def _turned(vectors: DataFrame, key: str, turn: np.ndarray) -> DataFrame:
    """The vectors times a small matrix."""
    columns = [sum((F.col("v")[i] * float(x) for i, x in enumerate(c)), F.lit(0.0)) for c in turn.T] if turn.size <= 64 else None
    if columns is not None:
        return vectors.select(key, F.array(*columns).alias("v"))
    d = len(turn)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d) @ turn
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * turn.shape[1], pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "v"])

    return vectors.select(key, "v").mapInArrow(one, f"{key} {vectors.schema[key].dataType.simpleString()}, v array<double>")


def _orthonormal(vectors: DataFrame, d: int) -> tuple[DataFrame, int]:
    """The same span by orthonormal columns, twice for rounding's sake; directions that are not there go."""
    for _ in range(2):
        e, u = np.linalg.eigh(_gram(vectors, d))
        some = e > 1e-13 * max(e.max(initial=0), 1e-300)
        vectors = _cut(_turned(vectors, "topic", u[:, some] / np.sqrt(e[some])))
        d = int(some.sum())
    return vectors, d


def _sums(weights: DataFrame, vectors: DataFrame, by: str, to: str, d: int) -> DataFrame:
    joined = weights.join(vectors, by)
    return joined.groupBy(to).agg(*[F.sum(F.col("weight") * F.col("v")[i]).alias(f"s{i}") for i in range(d)])


def latent_topics(weights: DataFrame, k: int, nodes: DataFrame | None = None, centre: bool = True, spare: int = 30, rounds: int = 100, tol: float = 1e-10, seed: int = 0) -> Topics:
    """The ``k`` leading singular values and vectors of weights(node, topic, weight), of which each topic's mean over all nodes is taken off first.

    Nodes are those of ``nodes``(node), else those that have a weight.  Repeated pairs add up; null ends and weights that are null or not finite are left out.
    ``k + spare`` vectors are iterated until the values move by ``tol`` of the largest at most; fewer come back where the relation has a lower rank.
    An axis has its largest loading positive (ties: any).
    """
    finite = F.col("weight").cast("double")
    w = weights.select("node", "topic", finite.alias("weight")).filter("node is not null and topic is not null").filter(F.abs("weight") < float("inf"))
    every = (w if nodes is None else nodes).select("node").filter("node is not null").distinct()
    w = _cut(w if nodes is None else w.join(every, "node", "left_semi"))
    every = _cut(every)
    n = every.count()
    means = _cut(w.groupBy("topic").agg((F.sum("weight") / max(n, 1)).alias("mean")))
    d = min(k + spare, means.count())
    kinds = [w.schema[c].dataType.simpleString() for c in ("node", "topic")]
    none = w.sparkSession.createDataFrame([], f"node {kinds[0]}, topics array<double>"), w.sparkSession.createDataFrame([], f"topic {kinds[1]}, loading array<double>")
    if not d:
        return Topics([], *none)
    q, d = _orthonormal(means.select("topic", F.array(*[_normal(F.col("topic"), i, seed) for i in range(d)]).alias("v")), d)
    last = None
    for i in range(rounds):
        shift = means.join(q, "topic").agg(*[F.coalesce(F.sum(F.col("mean") * F.col("v")[j]), F.lit(0.0)) for j in range(d)]).first() if centre else [0.0] * d
        y = _sums(w, q, "topic", "node", d).select("node", F.array(*[F.col(f"s{j}") - float(shift[j]) for j in range(d)]).alias("v"))
        y = _cut(y)
        e, u = np.linalg.eigh(_gram(y, d) + (n - y.count()) * np.outer(shift, shift))
        e, u = np.maximum(e[::-1], 0), u[:, ::-1]
        if i == rounds - 1 or last is not None and np.abs(e[:k] - last[:k]).max() <= tol * e[0]:
            break
        last = e
        z = _cut(_sums(w, y, "node", "topic", d).select("topic", F.array(*[F.col(f"s{j}") for j in range(d)]).alias("v")))
        z, new = _orthonormal(z, d)
        if not new:
            break
        last = last[:new]
        q, d = z, new
    axes = u[:, : min(k, int((e > 1e-12 * max(e[0], 1e-300)).sum()))]
    if not axes.shape[1]:
        return Topics([], *none)
    loadings = _cut(_turned(q, "topic", axes))
    ends = loadings.agg(*[F.max_by(F.col("v")[i], F.struct(F.round(F.abs(F.col("v")[i]), 9), "topic")) for i in range(axes.shape[1])]).first()
    signs = np.where(np.array(ends) < 0, -1.0, 1.0)
    blank = F.array(*[F.lit(float(-x)) for x in shift])
    full = every.join(y, "node", "left").select("node", F.coalesce("v", blank).alias("v"))
    turned = _turned(full, "node", axes * signs).withColumnRenamed("v", "topics")
    flipped = F.array(*[F.col("v")[i] * float(s) for i, s in enumerate(signs)])
    return Topics([float(x) for x in np.sqrt(e[: axes.shape[1]])], turned, loadings.select("topic", flipped.alias("loading")))
