"""What large tables need: nodes that never pass the driver, and rows that stay small."""

import re

import numpy as np
from pyspark.sql import functions as F

from lodevein.plans import search, summarize


def plans_since(spark, count=None):
    """The number of executions so far, or the plans of those after ``count``."""
    store = spark._jsparkSession.sharedState().statusStore()
    if count is None:
        return store.executionsCount()
    runs = store.executionsList()
    return [runs.apply(i).physicalPlanDescription() for i in range(count, runs.size())]


def test_summaries_never_broadcast_nodes(spark):
    """Cached columns of ids look small, but a broadcast of them builds a table of all nodes in the driver."""
    n = 400
    nodes = spark.range(n).select(F.col("id").alias("node_id"))
    support = spark.range(n).select((F.col("id") % 4).cast("int").alias("cut"), F.col("id").alias("node"))
    edges = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") * 7 + 4) % n).alias("dst")).filter("src != dst")
    before = plans_since(spark)
    _, done = summarize.summarize(nodes, edges, support, 0.01, rounds=2)
    plans = plans_since(spark, before)
    assert len(done) == 2 and plans
    assert not [p for p in plans if re.search(r"BroadcastHashJoin[^\n]*\n(?:Left|Right) keys \[\d+\]: \[node#", p)]


def test_a_sweep_takes_its_edges_in_turns(spark, monkeypatch):
    """What edges shuffle with the attributes of their ends is on disk for one turn at a time; counts are those of one turn."""
    rng = np.random.default_rng(5)
    owned = spark.createDataFrame([(u, np.flatnonzero(rng.random(10) < 0.4).tolist()) for u in range(30)], "node long, by array<int>")
    pairs = sorted({(int(min(e)), int(max(e))) for e in rng.integers(0, 32, (200, 2)) if e[0] != e[1]})  # two ends own nothing and are no nodes
    edges, released = spark.createDataFrame(pairs, "src long, dst long"), []
    sweep = lambda: [tuple(r) for r in search.beam_owners(owned, edges, [5, 10], search.Task([], size=4), search.si_uniform, 32, 2 * len(pairs)).collect()]
    want = sweep()
    monkeypatch.setattr(search, "TURN_EDGES", len(pairs) // 3)
    monkeypatch.setattr(search, "release", lambda spark: released.append(1))
    assert sweep() == want and len(want) == 8
    assert len(released) >= 3 + 1
