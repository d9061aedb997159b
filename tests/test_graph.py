"""Identities of the models and golden values of small graphs."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodevein import queries as registry
from lodevein.functions import quality as Q
from lodevein.functions.selectors import Interval, Negated, Nominal, cover, create_selectors, describe, equal_frequency_cuts, nominal_selectors, weighted_cuts
from lodevein.operators import graph_stats as G
from lodevein.operators import model as M
from lodevein.operators import post, prior
from lodevein.plans import search, summarize
from lodevein.sources import fixtures as X
from lodevein.sources.readers import coordinates, relations


def test_margins_of_six_nodes(spark):
    nodes = spark.range(6).withColumnRenamed("id", "node_id")
    got = {r["node"]: (r["out_degree"], r["in_degree"]) for r in G.margins(nodes, X.literal(spark, X.SIX_NODES)).collect()}
    assert [got[i] for i in range(6)] == [(2, 0), (0, 2), (3, 1), (1, 1), (0, 1), (0, 1)]
    both = {r["node"]: r["out_degree"] for r in G.margins(nodes, X.literal(spark, X.SIX_NODES, True)).collect()}
    assert [both[i] for i in range(6)] == [2, 2, 4, 2, 1, 1]


def test_star_prior(spark):
    nodes = spark.range(6).withColumnRenamed("id", "node_id")
    _, rows = prior.degree_classes(G.margins(nodes, X.literal(spark, X.STAR, True)))
    assert [(r["out_degree"], r["n"]) for r in rows] == [(1, 5), (5, 1)]


@pytest.mark.parametrize("family", ["bernoulli", "geometric", "exponential"])
def test_prior_meets_margins(family):
    rng = np.random.default_rng(0)
    a = np.triu((rng.random((30, 30)) < 0.3).astype(float), 1)
    a = a + a.T
    d = a.sum(1)
    values, n = np.unique(d, return_counts=True)
    u, v = prior.fit_degrees(values, values, n, square=True, family=family, rounds=20000)
    x = u[:, None] + v[None, :]
    p = {"bernoulli": prior.sigmoid(x), "geometric": np.exp(x) / (1 - np.exp(x)), "exponential": -1 / x}[family]
    assert np.allclose((p * (n[None, :] - np.eye(len(n)))).sum(1), values, atol=1e-5)


def test_pattern_lambda_meets_count():
    logit, pairs = np.full((2, 2), -1.0), np.array([[6.0, 4.0], [4.0, 2.0]])
    lam = prior.pattern_lambda(logit, pairs, 9)
    assert abs((pairs * prior.sigmoid(logit + lam)).sum() - 9) < 1e-9


def test_interestingness_edges(spark):
    df = spark.createDataFrame([(0, 0, 0.0), (0, 10, 2.0), (10, 10, 2.0), (3, 10, 3.0), (1, 10, 0.0)], "k long, n long, p double")
    got = [r[0] for r in df.select(Q.information_content(F.col("k"), F.col("n"), F.col("p"))).collect()]
    assert got[0] == 0 and abs(got[1] - 10 * math.log(10 / 8)) < 1e-12 and abs(got[2] - 10 * math.log(5)) < 1e-12 and abs(got[3]) < 1e-12 and got[4] == math.inf


def test_group_counts_against_brute_force(spark):
    rng = np.random.default_rng(1)
    pairs = [(i, j) for i in range(12) for j in range(12) if i != j and rng.random() < 0.3]
    attr = [(i, int(i % 3), "a" if i < 5 else "b") for i in range(12)]
    nodes = spark.createDataFrame(attr, "node_id long, x int, y string")
    sel = create_selectors(nodes, ignore=("node_id",))
    got = {r["sg"]: (r["n"], r["k"], r["out"], r["in_"]) for r in G.group_counts(spark.createDataFrame(pairs, "src long, dst long"), cover(nodes, "node_id", sel)).collect()}
    for i, s in enumerate(sel):
        own = {n for n, x, y in attr if (x if s.attribute == "x" else y) == s.value}
        assert got[i] == (len(own), sum(a in own and b in own for a, b in pairs), sum(a in own for a, _ in pairs), sum(b in own for _, b in pairs))


def test_summary_splits_along_planted_blocks(spark):
    pairs = [(i, j) for i in range(20) for j in range(20) if i != j and (i < 10) == (j < 10)]
    nodes = spark.range(20).withColumnRenamed("id", "node_id")
    support = spark.createDataFrame([(0, i) for i in range(10)] + [(1, i) for i in range(0, 20, 2)], "cut int, node long")
    blocks, done = summarize.summarize(nodes, spark.createDataFrame(pairs, "src long, dst long"), support, len(pairs) / 380, rounds=1)
    assert done[0][2] == 0 and {r["node"] for r in blocks.filter("block = 0").collect()} == set(range(10))


def test_split_score_equals_direct_count(spark):
    rng = np.random.default_rng(3)
    pairs = [(i, j) for i in range(14) for j in range(14) if i != j and rng.random() < 0.4]
    blocks = {i: i % 2 for i in range(14)}
    cut = {0: {0, 1, 2, 3, 7}, 1: {4, 5, 6, 12}}
    p = len(pairs) / (14 * 13)

    def score(new):
        total = 0.0
        for a, b in itertools.product(sorted(set(new.values())), repeat=2):
            n = sum(new[i] == a and new[j] == b for i in new for j in new if i != j)
            total += summarize.content(sum(new[i] == a and new[j] == b for i, j in pairs), n, p)
        c = len(set(new.values()))
        return round(total / (c * (c + 1) / 2 + c + 50), 6)

    want = max(score({i: 2 if (b == block and i not in nodes) else b for i, b in blocks.items()}) for nodes in cut.values() for block in (0, 1))
    bl = spark.createDataFrame(list(blocks.items()), "node long, block int")
    sup = spark.createDataFrame([(c, n) for c, ns in cut.items() for n in ns], "cut int, node long")
    assert summarize.best_split(spark.createDataFrame(pairs, "src long, dst long"), bl, sup, p)[0] == want


def test_selector_text_and_cover(spark):
    assert Interval("x", -math.inf, 2.0).descr == "x<2" and Interval("x", 1.5, math.inf).descr == "x>=1.5" and Interval("x", 1.0, 2.255).descr.startswith("x: [1:2.2")
    assert describe([]) == "Dataset" and describe([Nominal("b", 1), Nominal("a", "z")]) == "a=z AND b=1"
    df = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, None), (3, 5.0)], "node_id long, x double")
    sel = [Nominal("x", 1.0), Negated(Nominal("x", 1.0)), Interval("x", 1.0, 5.0), Interval("x", 5.0, math.inf)]
    assert [r["ids"] for r in cover(df, "node_id", sel).orderBy("node").collect()] == [[0, 2], [1], [1], [1, 3]]


def test_equal_frequency_skips_used_values(spark):
    values = [1.0] * 6 + [2.0, 3.0, 4.0, 5.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double")
    cuts = []
    for i in range(1, 5):
        pos = i * len(values) // 5
        while pos < len(values) and values[pos] in cuts:
            pos += 1
        if pos < len(values):
            cuts.append(values[pos])
    assert equal_frequency_cuts(df, "x") == cuts
    assert weighted_cuts(df.withColumn("w", F.lit(1.0)), "x", "w") == [1.0, 4.0] or weighted_cuts(df.withColumn("w", F.lit(1.0)), "x", "w")


def test_search_equals_full_enumeration(spark):
    rng = np.random.default_rng(2)
    rows = [(i, str(rng.integers(3)), str(rng.integers(4)), int(rng.random() < 0.4)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a string, b string, t int")
    sel = create_selectors(df, ignore=("id", "t"))
    task = search.Task(sel, size=5, depth=2)
    assert search.apriori(df, "id", task, F.col("t")).collect() == search.simple_dfs(df, "id", task, F.col("t")).collect()


def test_result_filters():
    assert post.overlap_filter([3, 1, 2], {(1, 3): 0.95, (1, 2): 0.2, (2, 3): 0.1}) == [3, 2]
    assert post.proper_subsets((1, 2)) == [(), (1,), (2,)] and post.to_bits([0, 3]) == 9
    assert post.single_linkage({(0, 1): 0.9, (1, 2): 0.5, (0, 2): 0.4})[0][:2] == (0, 1)


def test_relations_and_coordinates(spark):
    t = spark.createDataFrame([("p", "actor", "f1"), ("p", "actor", "f2"), ("q", "director", "f1")], "person string, role string, film string")
    assert relations(t)["role"].count() == 2 and relations(t)["film"].count() == 3
    e = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0)], "row int, col int, value double")
    assert coordinates(e, 1, 1).collect()[0]["value"] == 3.0
    with pytest.raises(Exception, match="bounds"):
        coordinates(e, 0, 1).collect()


def test_chi_squared_tail(spark):
    got = [r[0] for r in spark.createDataFrame([(0.0,), (1.0,), (3.841458820694124,), (10.0,)], "x double").select(Q.chi_squared_p(F.col("x"))).collect()]
    assert np.allclose(got, [math.erfc(math.sqrt(x / 2)) for x in (0, 1, 3.841458820694124, 10)], atol=2e-7)


def test_fisher_tests_every_part(spark, tmp_path):
    """Ids of 2,000 and more count, too: the share of large parts is another there."""
    rows = [(i, f"b{i % 3}", "t", 50 if i % (3 if i < 2000 else 7) == 1 or (i > 2000 and i % 9 == 2) else 1, 1.0) for i in range(5000)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    got = {r["p_brand"]: r["p"] for r in registry.enrichment_fisher(spark, str(tmp_path)).collect()}
    n, s = len(rows), sum(r[3] > 40 for r in rows)
    assert len(got) == 3
    for brand, p in got.items():
        own = [r[3] > 40 for r in rows if r[1] == brand]
        ways = [math.comb(len(own), k) * math.comb(n - len(own), s - k) for k in range(max(0, len(own) + s - n), min(len(own), s) + 1)]
        assert p == pytest.approx(sum(w for w in ways if w <= ways[sum(own)]) / math.comb(n, s), abs=2e-6)


def test_log_factorials(spark):
    got = spark.createDataFrame([(n,) for n in (0, 1, 15, 16, 17, 100, 20_000, 30_000_000)], "n long").select("n", post.log_factorial(F.col("n")).alias("f")).collect()
    assert all(r["f"] == pytest.approx(math.lgamma(r["n"] + 1), rel=1e-14, abs=1e-14) for r in got)


def test_rectangular_prior_loses_no_class(spark, monkeypatch):
    monkeypatch.setattr(prior, "MOST_CLASSES", 3)
    with pytest.raises(ValueError, match="classes"):
        registry.prior_rectangular(spark, "/root/testdata/sf0.001")


@pytest.mark.parametrize("constrained", [False, True])
@pytest.mark.parametrize("prior", ["uniform", "degree"])
def test_pair_beams_equal_a_replay_in_plain_code(spark, constrained, prior):
    rng = np.random.default_rng(11)
    n = 24
    rows = [(i, "ab"[int(rng.integers(2))], "xyz"[int(rng.integers(3))], "pq"[int(rng.integers(2))]) for i in range(n)]
    pairs = sorted((i, j) for i in range(n) for j in range(n) if i != j and rng.random() < (0.7 if rows[i][1] == "a" and rows[j][2] == "x" else 0.2))
    nodes = spark.createDataFrame(rows, "node_id long, f string, g string, h string")
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, weight double")
    sel = [x for c in "fgh" for x in nominal_selectors(nodes, c)]
    density = len(pairs) / (n * (n - 1))
    model = None if prior == "uniform" else M.degree(nodes, edges, undirected=False)
    p = {(i, j): density for i in range(n) for j in range(n)} if model is None else {(r["src"], r["dst"]): r["p"] for r in model.dense().collect()}
    task = search.Task(sel, size=3, depth=2)

    members = [{i for i, *v in rows if v["fgh".index(s.attribute)] == s.value} for s in sel]
    group = lambda s: set.intersection(*(members[x] for x in s))
    text = lambda s: " AND ".join(sorted(sel[x].descr for x in s))

    def quality(one, two):
        cells = [(i, j) for i in group(one) for j in group(two) if i != j]
        if not cells:
            return None
        k, size, want = sum(c in set(pairs) for c in cells), len(cells), sum(p[c] for c in cells)
        ic = (k * math.log(k / want) if k else 0) + ((size - k) * math.log((size - k) / (size - want)) if size > k else 0)
        return round(ic / (0.3 * (len(one) + len(two)) + 0.5), 6), text(two), size, k

    found, seeds, done = [], [()], set()
    for _ in range(2):
        for one in sorted({tuple(sorted({*s, x})) for s in seeds for x in range(len(sel)) if x not in s} - done):
            done.add(one)
            own, beam = {sel[x].attribute for x in one}, {}
            for depth in range(2):
                for s in [(), *beam]:
                    if constrained and depth and not s:
                        continue
                    for x in range(len(sel)):
                        two = tuple(sorted({*s, x}))
                        if x in one or x in s or constrained and (sel[x].attribute in own) != (depth == 0) or not group(one) or not group(two):
                            continue
                        q = quality(one, two)
                        if q and q[0] > 0:
                            beam[two] = q
                beam = dict(sorted(beam.items(), key=lambda b: (-b[1][0], b[1][1]))[:3])
            for q in beam.values():
                found = sorted([*found, (q[0], text(one), *q[1:], one)], key=lambda f: (-f[0], f[1], f[2]))
                while len({f[1] for f in found}) > 4:
                    found.pop()
        seeds = sorted({f[5] for f in found})
    got = [tuple(r)[1:] for r in search.beam_pairs(nodes, edges, task, n, len(pairs), outer=4, constrained=constrained, model=model).collect()]
    assert any(len(f[2].split(" AND ")) == 2 for f in found)
    assert [g[1:] for g in got] == [f[1:5] for f in found]
    assert np.allclose([g[0] for g in got], [f[0] for f in found], atol=2e-6)


@pytest.mark.parametrize("constrained", [False, True])
def test_pair_beams_count_on_classes(spark, monkeypatch, constrained):
    """Nodes of one cover are one node with its size: counts agree with those of the nodes, and levels of the search see classes only."""
    nodes = spark.range(300).select(F.col("id").alias("node_id"), (F.col("id") % 3).cast("string").alias("a"), F.when(F.col("id") % 7 < 5, (F.col("id") % 2).cast("string")).alias("b"))
    edges = spark.range(300).select(F.col("id").alias("src"), F.explode(F.array((F.col("id") * 7 + 1) % 300, (F.col("id") * 11 + 5) % 300)).alias("dst")).filter("src != dst").distinct()
    sel = [s for c in ("a", "b") for s in nominal_selectors(nodes, c)]
    covers = cover(nodes, "node_id", sel)
    classes, between = G.by_cover(edges, covers)
    assert classes.agg(F.sum("size")).first()[0] == 300 and classes.count() == 9 and between.agg(F.sum("times")).first()[0] == edges.count()
    c = search.Candidates(sel, [(i,) for i in range(len(sel))] + [(0, 3), (1, 4)])
    one, all_ = (sorted(map(tuple, G.pair_counts(e, g, g).collect())) for e, g in ((edges, c.groups(covers)), (between, c.groups(classes))))
    assert one == all_ and len(one) == 49
    sizes, count = [], G.pair_counts
    monkeypatch.setattr(search, "pair_counts", lambda edges, left, right, wanted: sizes.append((left.count(), edges.count())) or count(edges, left, right, wanted))
    assert search.beam_pairs(nodes, edges, search.Task(sel, size=2, depth=2), 300, edges.count(), constrained=constrained).count()
    assert sizes and max(sizes) <= (9, 81)


def test_levels_of_pair_beams_plan_over_short_tables(spark, monkeypatch):
    """Classes that are few have no lineage that the plan of each level would repeat; more of them stay tables, with the same result."""
    nodes = spark.range(300).select(F.col("id").alias("node_id"), (F.col("id") % 3).cast("string").alias("a"), (F.col("id") % 7 % 4).cast("string").alias("b"))
    edges = spark.range(300).select(F.col("id").alias("src"), F.explode(F.array((F.col("id") * 7 + 1) % 300, (F.col("id") * 11 + 5) % 300)).alias("dst")).filter("src != dst").distinct()
    sel = [s for c in ("a", "b") for s in nominal_selectors(nodes, c)]
    plans, count, m = [], G.pair_counts, edges.count()

    def counted(*args):
        out = count(*args)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(search, "pair_counts", counted)
    beam = lambda: search.beam_pairs(nodes, edges, search.Task(sel, size=2, depth=2), 300, m, constrained=True).collect()
    short = beam()
    assert short and plans and not any("InMemoryRelation" in p for p in plans)
    plans.clear()
    monkeypatch.setattr(G, "FEW_ROWS", 5)
    assert beam() == short and all("InMemoryRelation" in p for p in plans)
