"""Latent topics of sparse relations against a dense decomposition."""

import numpy as np
import pytest

from lodevein.operators.latent import latent_topics


def relation(spark, a):
    return spark.createDataFrame([(int(i), f"t{j}", float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "node long, topic string, weight double").repartition(3)


@pytest.mark.parametrize("centre", [True, False])
def test_against_dense(spark, centre):
    rng = np.random.default_rng(4)
    a = (rng.random((60, 40)) < 0.2) * rng.random((60, 40)) + np.outer(rng.random(60) < 0.3, rng.random(40) < 0.3) + 0.5 * np.outer(rng.random(60) < 0.3, rng.random(40) < 0.3)
    a[7] = 0  # a node without topics is a row of zeros
    got = latent_topics(relation(spark, a), 3, spark.range(60).toDF("node"), centre=centre, spare=8)
    c = a - a.mean(0) * centre
    u, s, vt = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(got.values, s[:3], atol=1e-7)
    rows = {r["node"]: r["topics"] for r in got.nodes.collect()}
    assert len(rows) == 60
    axes = vt[:3] * np.sign(vt[:3][np.arange(3), np.abs(vt[:3]).argmax(1)])[:, None]
    assert np.allclose([rows[i] for i in range(60)], c @ axes.T, atol=1e-3)
    load = {r["topic"]: r["loading"] for r in got.loadings.collect()}
    assert np.allclose([load[f"t{j}"] for j in range(40)], axes.T, atol=1e-3)


def test_many_topics_without_a_dense_matrix(spark):
    """Thirty thousand topics, two planted groups of them."""
    rng = np.random.default_rng(2)
    rows = [(i, int(t), 1.0) for i in range(300) for t in rng.choice(10_000, 20, replace=False) + 10_000 * (i % 3)]
    rows += [(i, 30_000 + i % 3, 8.0) for i in range(300)]
    got = latent_topics(spark.createDataFrame(rows, "node long, topic long, weight double"), 2, spare=6, rounds=6, tol=1e-4)
    x = {r["node"]: r["topics"] for r in got.nodes.collect()}
    middle = np.array([np.mean([x[i] for i in range(g, 300, 3)], 0) for g in range(3)])
    spread = max(np.std([x[i] for i in range(g, 300, 3)], 0).max() for g in range(3))
    assert len(got.values) == 2 and min(np.linalg.norm(middle[i] - middle[j]) for i in range(3) for j in range(i)) > 10 * spread


def test_odd_relations(spark):
    schema = "node long, topic string, weight double"
    empty = latent_topics(spark.createDataFrame([], schema), 2)
    assert empty.values == [] and empty.nodes.collect() == [] and empty.loadings.collect() == []
    odd = [(1, "a", 1.0), (1, "a", 1.0), (2, "a", 1.0), (2, None, 5.0), (None, "b", 5.0), (3, "b", None), (3, "b", float("nan")), (3, "b", float("inf")), (3, "a", 0.0)]
    got = latent_topics(spark.createDataFrame(odd, schema), 2)
    assert np.allclose(got.values, [np.sqrt(2)]) and {r["node"]: round(r["topics"][0], 9) for r in got.nodes.collect()} == {1: 1, 2: 0, 3: -1}
