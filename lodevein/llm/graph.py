"""Connected components over tables of edges."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevein.llm.common import settle


def _root(up: dict[int, int], i: int) -> int:
    while up.setdefault(i, i) != i:
        up[i] = up[up[i]]
        i = up[i]
    return i


def _merged(edges: DataFrame) -> DataFrame:
    """node, component of a table of few edges, which the driver reads."""
    found = edges.select("a", "b").toArrow()
    up: dict[int, int] = {}
    for a, b in zip(found.column("a").to_pylist(), found.column("b").to_pylist(), strict=True):
        x, y = _root(up, a), _root(up, b)
        up[max(x, y)] = min(x, y)
    kind = found.schema.field("a").type
    return settle(edges.sparkSession.createDataFrame(pa.table({"node": pa.array(list(up), kind), "component": pa.array([_root(up, i) for i in list(up)], kind)})))


def components(edges: DataFrame, few: int = 0) -> DataFrame:
    """node, component (smallest node that is reachable) for every node of edges(a, b).

    Every round gives each node the smallest of its neighbours and itself, follows that once more, and
    contracts the edges, until none is left.  Minima are partial aggregates, so a hub is no large group; loops and
    repeated edges are dropped.  Rounds are written to the shared folder.  Once ``few`` edges at most are left, the driver
    reads and merges them, instead of rounds of jobs for a handful of rows; with 0 nothing is collected.
    """
    ordered = lambda df, a, b: df.filter(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    known = edges.filter("a is not null and b is not null")
    if few and known.count() <= few:
        return _merged(known.filter("a != b"))
    left = settle(ordered(known, F.col("a"), F.col("b")))
    found = None
    while True:
        last = bool(few) and found is not None and left.count() <= few
        if last:
            step = _merged(left).withColumnRenamed("component", "up")
        else:
            both = left.select("a", "b").union(left.select(F.col("b"), F.col("a")))
            parents = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up"))
            jumped = parents.alias("x").join(parents.alias("y"), F.col("x.up") == F.col("y.node")).select("x.node", F.col("y.up").alias("up"))
            step = settle(jumped)
        found = step.withColumnRenamed("up", "component") if found is None else found.join(step.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        if last:
            return settle(found)
        up = lambda c: step.select(F.col("node").alias(c), F.col("up").alias(f"up_{c}"))
        left = settle(ordered(left.join(up("a"), "a").join(up("b"), "b"), F.col("up_a"), F.col("up_b")))
        if left.isEmpty():
            return settle(found)
