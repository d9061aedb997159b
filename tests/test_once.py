"""Undirected graphs whose edges are there once: the same counts as from both directions, in tasks whose number follows the table."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodevein.operators import graph_stats as G
from lodevein.operators import model as M
from lodevein.operators import post
from lodevein.plans import summarize
from lodevein.sources import fixtures as X

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def graph(spark):
    """Nodes, edges once, edges in both directions, groups; some nodes are in no group, one has no edge."""
    rng = np.random.default_rng(2)
    pairs = sorted({(int(min(e)), int(max(e))) for e in rng.integers(0, 39, (200, 2)) if e[0] != e[1]})
    once = spark.createDataFrame(pairs, "src long, dst long")
    nodes = spark.createDataFrame([(u,) for u in range(40)], "node_id long")
    groups = spark.createDataFrame([(u, [] if u % 7 == 0 else [u % 3, 3 + u % 4]) for u in range(40)], "node long, ids array<int>")
    return nodes, once, G.symmetric(once), groups


def rows(df):
    return sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())


def test_pairs_of_parts_are_made_in_tasks_of_so_many_lines(spark, monkeypatch):
    lines = X.table(spark, SF, "lineitem").select("l_orderkey", "l_partkey")
    monkeypatch.setattr(X, "LINES", 100)
    made = X.copurchase_once(spark, SF)
    assert made.rdd.getNumPartitions() == -(-lines.count() // 100)
    want = {(a["l_partkey"], b) for a in lines.join(lines.withColumnRenamed("l_partkey", "b"), "l_orderkey").collect() for b in [a["b"]] if a["l_partkey"] != b}
    assert {tuple(r) for r in X.copurchase(spark, SF).collect()} == want == {e for a, b in rows(made.select(F.col("src").alias("a"), F.col("dst").alias("b"))) for e in ((a, b), (b, a))}
    assert made.filter("src >= dst").isEmpty()


def test_twice_the_table_takes_twice_the_tasks(spark, monkeypatch, tmp_path):
    """No exchange of prior_uniform that holds lines or pairs stays at Spark's own number of partitions."""
    from lodevein import queries

    monkeypatch.setattr(X, "LINES", 100, raising=False)
    for name, keys in (("lineitem", ("l_orderkey", "l_partkey")), ("part", ("p_partkey",))):
        one = X.table(spark, SF, name)
        one.union(one.withColumns({c: F.col(c) + 1_000_000 for c in keys})).write.parquet(f"{tmp_path}/{name}.parquet")
    lines = X.table(spark, SF, "lineitem").select("l_orderkey", "l_partkey")
    own, count = lines.collect(), X.table(spark, SF, "part").count()
    by_order = {}
    for order, part in own:
        by_order.setdefault(order, set()).add(part)
    pairs = len({(a, b) for some in by_order.values() for a in some for b in some if a != b})
    for sf, times in ((SF, 1), (str(tmp_path), 2)):
        logit = queries.prior_uniform(spark, sf)
        plan = logit._jdf.queryExecution().executedPlan().toString()
        assert {int(n) for n in re.findall(r"hashpartitioning\([^)]*, (\d+)\)", plan)} == {-(-times * len(own) // 100)}
        density = times * pairs / (times * count * (times * count - 1))
        assert logit.first()["logit"] == pytest.approx(np.log(density / (1 - density)), abs=1e-9)


def test_counts_from_edges_once(graph):
    nodes, once, both, groups = graph
    assert G.totals(nodes, once, once=True) == G.totals(nodes, both)
    assert rows(G.margins(nodes, once, once=True)) == rows(G.margins(nodes, both))
    covers, between = G.by_cover(once, groups, once=True, every=True)
    assert rows(G.group_counts(between, covers)) == rows(G.group_counts(both, groups))
    assert rows(G.pair_counts(between, covers, covers)) == rows(G.pair_counts(both, groups, groups))


def test_edges_meet_their_ends_in_tasks_that_follow_the_table(spark, monkeypatch):
    """Spark's own number of partitions is 4 here."""
    from lodevein import queries

    lines = X.table(spark, SF, "lineitem").count()
    monkeypatch.setattr(X, "LINES", 100)
    used, read = [], G.by_cover
    monkeypatch.setattr(G, "by_cover", lambda *a, **k: used.append(read(*a, **k)) or used[-1])
    counts = rows(queries._counts(spark, SF)[2])
    plan = used[0][1]._jdf.queryExecution().executedPlan().toString()
    assert all(f"hashpartitioning({c}#" in plan for c in ("src", "dst"))
    for c in ("src", "dst"):
        assert {int(n) for n in re.findall(rf"hashpartitioning\({c}#\d+L?, (\d+)\)", plan)} == {-(-lines // 100)}
    nodes, edges = X.parts(spark, SF), X.copurchase(spark, SF)
    sel = queries.part_selectors(nodes)
    want = G.group_counts(edges, queries.cover(nodes, "node_id", sel)).join(queries.selector_table(spark, sel), "sg")
    assert counts == rows(want)


def test_models_from_edges_once(graph):
    nodes, once, both, groups = graph
    labelled = nodes.withColumn("label", F.col("node_id") % 2)
    for kind, label in (("uniform", None), ("degree", None), ("blocks", "label")):
        a, b = (M.fit(kind, labelled, e, label, once=e is once) for e in (once, both))
        assert np.allclose(a.logit, b.logit) and rows(a.nodes) == rows(b.nodes)
        for cells, of in ((a.row(5), a.nodes.select(F.lit(5).cast("long").alias("src"), F.col("node").alias("dst"))), (a.column(5), a.nodes.select(F.col("node").alias("src"), F.lit(5).cast("long").alias("dst")))):
            assert rows(cells) == rows(a.cells(of))


def test_a_summary_reads_its_edges_once(graph, monkeypatch):
    nodes, once, both, groups = graph
    support = groups.select(F.explode("ids").alias("cut"), "node")
    want = summarize.summarize(nodes, both, support, 0.2)
    read, passes = summarize.by_cover, []
    monkeypatch.setattr(summarize, "by_cover", lambda *a, **k: passes.append(1) or read(*a, **k))
    got = summarize.summarize(nodes, once, support, 0.2, once=True)
    assert got[1] == want[1] and len(got[1]) == 3 and rows(got[0]) == rows(want[0])
    assert len(passes) == 1
    fresh = summarize.split_scores(both, got[0], support, summarize._flat(0.2, got[0]), {})
    ends = summarize.ends_of(both, got[0], support)
    assert rows(summarize.split_scores(both, got[0], support, summarize._flat(0.2, got[0]), {}, ends)) == rows(fresh)


def test_medians_without_a_task_for_a_group(spark, monkeypatch):
    """Odd, even, equal, negative, one and no values, more than cells or fewer; nulls and what is not finite are left out."""
    monkeypatch.setattr(post, "CELLS", 7)
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=101).tolist(), "b": rng.integers(0, 5, 60).tolist(), "c": [3.5], "d": [2.0, 2.0], "e": [-1e9, 1.0, 2.0, 1e9], "f": [0.1] * 50 + [0.2] * 50, "g": rng.random(1000).tolist(), "h": [5.0, 1e300, -1e300]}
    rows = [(k, float(v)) for k, some in groups.items() for v in some] + [("a", None), ("a", float("inf")), ("none", None)]
    got = dict(post.exact_medians(spark.createDataFrame(rows, "k string, x double"), "k", "x").collect())
    assert got == pytest.approx({k: float(np.median(v)) for k, v in groups.items()})
