"""Background models, mining and the readers, against dense arithmetic and hand-made files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodevein.functions.selectors import Nominal, cover
from lodevein.operators import model as M
from lodevein.operators import post, prep, prior
from lodevein.plans import mining, search, summarize
from lodevein.sources import readers


def graph(spark, n=24, seed=3, directed=False):
    rng = np.random.default_rng(seed)
    a = rng.random((n, n)) < 0.25
    a[:6, :6] |= rng.random((6, 6)) < 0.6
    np.fill_diagonal(a, False)
    a = a if directed else a | a.T
    nodes = spark.createDataFrame([(i, "xy"[i < 9], "pqr"[i % 3]) for i in range(n)], "node_id long, u string, v string")
    edges = spark.createDataFrame([(int(i), int(j)) for i, j in zip(*np.nonzero(a), strict=True)], "src long, dst long")
    return nodes, edges, a.astype(float)


def dense(model, n):
    out = np.zeros((n, n))
    for r in model.dense().collect():
        out[r["src"], r["dst"]] = r["p"]
    return out


@pytest.mark.parametrize("kind", ["uniform", "degree", "blocks"])
@pytest.mark.parametrize("directed", [False, True])
def test_expected_edges_against_dense(spark, kind, directed):
    nodes, edges, a = graph(spark, directed=directed)
    m = M.fit(kind, nodes, edges, **({"label": "v"} if kind == "blocks" else {}), undirected=not directed)
    p = dense(m, len(a))
    if kind != "uniform":
        assert np.abs(p.sum(1) - a.sum(1)).max() < 1e-4 and np.abs(p.sum(0) - a.sum(0)).max() < 1e-4
    sel = [Nominal("u", "x"), Nominal("u", "y"), Nominal("v", "p")]
    groups = cover(nodes, "node_id", sel)
    member = [np.array([("xy"[i < 9] if s.attribute == "u" else "pqr"[i % 3]) == s.value for i in range(len(a))]) for s in sel]
    for r in m.expected(groups).collect():
        assert abs(r["p"] - p[np.ix_(member[r["sg"]], member[r["sg"]])].sum()) < 1e-8
    got = {(r["a"], r["b"]): r["p"] for r in m.expected_pairs(groups, groups).collect()}
    assert len(got) == 9 and all(abs(x - p[np.ix_(member[i], member[j])].sum()) < 1e-8 for (i, j), x in got.items())
    assert abs(sum(r["p"] for r in m.row(2).collect()) - p[2].sum()) < 1e-9 and abs(sum(r["p"] for r in m.column(2).collect()) - p[:, 2].sum()) < 1e-9


def test_patterns_update_the_model(spark):
    nodes, edges, a = graph(spark)
    m = M.degree(nodes, edges)
    p = dense(m, len(a))
    left, right = (nodes.filter(c).select(F.col("node_id").alias("node")) for c in ("node_id < 9", "node_id between 6 and 12"))
    k = int(a[:9, :9].sum())
    once, shift, before, gain = m.pattern(left, None, k)
    q = dense(once, len(a))
    assert abs(q[:9, :9].sum() - k) < 1e-6 and abs(before - p[:9, :9].sum()) < 1e-8 and np.allclose(q[9:, 9:], p[9:, 9:])
    off = ~np.eye(9, dtype=bool)
    like = lambda x: (a[:9, :9] * np.log(x[:9, :9] + np.eye(9)) + (1 - a[:9, :9]) * np.log(1 - x[:9, :9]))[off].sum()
    assert abs(gain - (like(q) - like(p))) < 1e-6 and once.lambdas == [shift]
    k2 = int(a[:9, 6:13].sum())
    twice, shift, _, _ = once.pattern(left, right, k2)
    r = dense(twice, len(a))
    logit = lambda x: np.log(x / (1 - x))
    assert abs(r[:9, 6:13].sum() - k2) < 1e-6
    assert abs(logit(r[0, 10]) - logit(q[0, 10]) - shift) < 1e-6 and abs(logit(r[7, 8]) - logit(q[7, 8]) - 2 * shift) < 1e-6 and abs(logit(r[10, 0]) - logit(q[10, 0]) - shift) < 1e-6


def test_sessions_go_on(spark, tmp_path):
    nodes, edges, _ = graph(spark)
    m, *_ = M.degree(nodes, edges).pattern(nodes.filter("node_id < 5").select(F.col("node_id").alias("node")), None, 12)
    m.save(str(tmp_path / "session"))
    again = M.Background.load(spark, str(tmp_path / "session"))
    assert np.array_equal(again.logit, m.logit) and again.lambdas == m.lambdas and again.undirected
    assert np.allclose(dense(again, 24), dense(m, 24))


def test_mining_rounds_against_dense(spark):
    nodes, edges, a = graph(spark)
    sel = [Nominal("u", "x"), Nominal("u", "y"), Nominal("v", "p"), Nominal("v", "q"), Nominal("v", "r")]
    found, last = mining.mine(nodes, edges, search.Task(sel, size=5, depth=1), M.degree(nodes, edges), rounds=3)
    p = dense(M.degree(nodes, edges), len(a))
    member = {s.descr: np.array([("xy"[i < 9] if s.attribute == "u" else "pqr"[i % 3]) == s.value for i in range(len(a))]) for s in sel}
    for r in found.orderBy("round").collect():
        def quality(d, p=p):
            x = member[d]
            n, k, e = x.sum() * (x.sum() - 1), a[np.ix_(x, x)].sum(), p[np.ix_(x, x)].sum()
            return (k * np.log(k / e) + (n - k) * np.log((n - k) / (n - e))) / 0.8
        best = min(member, key=lambda d: (-round(quality(d), 6), d))
        assert r["descr"] == best and abs(r["quality"] - quality(best)) < 1e-5
        x = np.outer(member[best], member[best]) & ~np.eye(len(a), dtype=bool)
        with np.errstate(divide="ignore"):
            p = np.where(x, 1 / (1 + np.exp(-np.log(p / (1 - p)) - r["lambda"])), p)
    assert found.count() == 3 and np.allclose(dense(last, len(a)), p)


def test_searches_agree(spark):
    rng = np.random.default_rng(2)
    data = spark.createDataFrame([(i, *map(str, rng.integers(0, 3, 4)), int(rng.random() < 0.3 + 0.1 * (i % 3 == 0))) for i in range(300)], "id long, a string, b string, c string, d string, t int").coalesce(2)
    sel = [Nominal(c, str(v)) for c in "abcd" for v in range(3)]
    task = search.Task(sel, size=12, depth=3)
    want = [tuple(r) for r in search.simple_dfs(data, "id", task, F.col("t"), 0.5).collect()]
    for kind in (search.apriori, search.best_first, search.tid_search, search.bitset_search):
        assert [tuple(r) for r in kind(data, "id", task, F.col("t"), 0.5).collect()] == want
    c = search.Candidates(sel, [(0, 3), (1, 4), (2,)])
    rows = cover(data, "id", sel)
    packed = {r["node"]: r["ids"] for r in c.groups(rows).collect()}
    c.packed = lambda: False
    assert packed == {r["node"]: r["ids"] for r in c.groups(rows).collect()} and packed


def test_dbscan_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.4, (30, 2)) for c in ((0, 0), (5, 5))] + [rng.uniform(-3, 8, (20, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, x double, y double")
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= 0.36
    core = near.sum(1) >= 5
    label = np.where(core, np.arange(len(x)), -1)
    for _ in range(len(x)):
        for i in np.flatnonzero(core):
            label[i] = label[near[i] & core].min()
    want = {i: int(label[i]) if core[i] else (int(label[near[i] & core].min()) if (near[i] & core).any() else None) for i in range(len(x))}
    got = prep.dbscan(df, "id", ["x", "y"], 0.6, 5).collect()
    assert {r["id"]: r["cluster"] for r in got} == want and {r["id"] for r in got if r["core"]} == set(np.flatnonzero(core).tolist())


def test_dbscan_of_crowds(spark, monkeypatch):
    """Copies, dense places, points exactly eps apart and values that aren't finite; neighbours are counted without listing pairs."""
    monkeypatch.setattr(prep, "PAIRS", 64)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 0.5, (150, 2)), np.repeat(rng.integers(3, 9, (40, 2)).astype(float), 3, 0), rng.uniform(-4, 12, (60, 2)), [[-0.0, 20.0], [0.0, 20.0], [1.0, 20.0]]])
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(len(x), float("nan"), 0.0), (len(x) + 1, float("inf"), 0.0), (len(x) + 2, None, 0.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    near = ((x[:, None] - x[None]) ** 2).sum(2) <= 1
    for least in (3, 6):
        core = near.sum(1) >= least
        label = np.where(core, np.arange(len(x)), -1)
        while (now := np.array([label[near[i] & core].min() if core[i] else -1 for i in range(len(x))])).tolist() != label.tolist():
            label = now
        want = {i: (int(label[near[i] & core].min()) if (near[i] & core).any() else None, bool(core[i])) for i in range(len(x))} | {len(x) + i: (None, False) for i in range(3)}
        assert {r["id"]: (r["cluster"], r["core"]) for r in prep.dbscan(df, "id", ["x", "y"], 1.0, least).collect()} == want
        assert {r["id"]: r["neighbours"] for r in prep.dbscan_cores(df, "id", ["x", "y"], 1.0, least).collect()} == {i: int(near[i].sum()) for i in range(len(x)) if core[i]}
    # A crowd of 40,000 positions makes 1.6 billion pairs.
    crowd = spark.range(40000).select("id", (F.col("id") % 200 / 400).alias("x"), (F.floor(F.col("id") / 200) / 400).alias("y"))
    assert prep.dbscan_cores(crowd, "id", ["x", "y"], 1.0).agg(F.min("neighbours"), F.count("*")).first() == (40000, 40000)
    assert prep.dbscan(crowd, "id", ["x", "y"], 1.0).groupBy("cluster", "core").count().collect() == [(0, True, 40000)]


def test_readers(spark, tmp_path):
    write = lambda name, text: (tmp_path / name).write_text(text, encoding="latin1") and str(tmp_path / name)
    nodes, edges = readers.open_graph(spark, "citations", cites=write("c", "p1\tp2\np3\tp1\n"), contents=write("w", "p1\t1\t0\tA\np2\t0\t1\tB\n"))
    assert {tuple(r) for r in edges.collect()} == {("p2", "p1"), ("p1", "p3")} and nodes.columns == ["node_id", "w0", "w1"]
    nodes, edges = readers.open_graph(spark, "regions", path=write("r", "code;name;near;share\n1;Köln;2, 3;0,5\n2;Bonn;1;1,25\n3;X;;2\n"))
    assert {tuple(r) for r in edges.collect()} == {(1, 2), (1, 3), (2, 1)} and {r["share"] for r in nodes.collect()} == {0.5, 1.25, 2.0}
    nodes, edges = readers.open_graph(spark, "edges", path=write("e", "1 2\n\n2 3\n"))
    assert nodes.count() == 3 and {tuple(r) for r in edges.collect()} == {(1, 2), (2, 3)}
    assert [tuple(r) for r in readers.edge_list(spark, write("ew", "1 2 0.5\n"), weighted=True).collect()] == [(1, 2, 0.5)]
    with pytest.raises(ValueError, match="unknown source"):
        readers.open_graph(spark, "stars")
    links = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    tags = spark.createDataFrame([(1, "rock"), (2, "jazz"), (3, "rock")], "tag_id long, tag string")
    hot, edges = readers.tagged(links, tags, spark.createDataFrame([(1, 1), (1, 3), (2, 2), (3, 3)], "node_id long, tag_id long"), 1)
    assert {tuple(r) for r in hot.collect()} == {(1, "rock"), (3, "rock")} and edges.count() == 4
    info = spark.createDataFrame([(1, *range(7)), (2, *range(7))], "node_id long, " + ", ".join(f"c{i} int" for i in range(7)))
    assert readers.people(links, info)[0].columns == ["node_id", *readers.PEOPLE]
    votes = spark.createDataFrame([(1, *([1] * 39))], "node_id long, " + ", ".join(f"v{i} int" for i in range(39)))
    made, friends = readers.members(links, votes, spark.createDataFrame([(1, 7, "Ann")], "node_id long, code int, name string"))
    assert made.first()["party"] == "Labour" and friends.count() == 4


def test_paper_corpus(spark, tmp_path):
    kdd, icml = "1130985203", "1180662882"
    paper = lambda i, venue, refs, fos, org: {"id": i, "title": i, "venue": {"id": venue, "raw": ""}, "references": refs, "fos": [{"name": n, "w": w} for n, w in fos], "authors": [{"name": "a", "org": org}]}
    lines = [paper("a", kdd, ["b", "b", "z"], [("x", 1.0), ("y", 0.5)], "MIT, MA, USA"), paper("b", icml, [], [("y", 1.0), ("y", 1.0)], "Univ, Spain"), paper("c", icml, ["a"], [("x", 1.0)], "nowhere"), paper("d", "77", ["a"], [], "Spain")]
    path = tmp_path / "papers.json"
    path.write_text("\n".join([json.dumps(x) for x in lines] + ["{broken", json.dumps({"id": "e", "title": "no venue"})]))
    t = readers.papers(spark, str(path), "dblp_ml_dm")
    ids = {r["id"]: r["node_id"] for r in t["papers"].collect()}
    assert ids == {"a": 0, "b": 1, "c": 2}
    assert {tuple(r) for r in t["edges"].collect()} == {(0, 1, 2), (2, 0, 1)}
    assert {r["topic"]: r["topic_id"] for r in t["topics"].collect()} == {"x": 0, "y": 1}
    assert {(r["node_id"], r["topic_id"]): r["weight"] for r in t["weights"].collect()}[1, 1] == 2.0
    assert {r["acronym"]: r["n"] for r in readers.members_per_venue(t["papers"], t["venues"]).collect()} == {"KDD": 1, "ICML": 2}
    some = readers.papers(spark, str(path), "dblp_ml_dm", with_countries=True)
    assert some["papers"].count() == 2 and {tuple(r) for r in some["countries"].collect()} == {("a", "MA"), ("a", "United States"), ("b", "Spain")}
    with pytest.raises(ValueError, match="venues"):
        readers.venues(spark, "none")


def test_plot_frames(spark):
    nodes, edges, _ = graph(spark)
    sel = [Nominal("u", "x"), Nominal("v", "p")]
    blocks, placed = mining.replay(nodes, sel, [(0, 0), (1, 0)], order="node_id")
    assert [(r["descr"], r["size"], r["upto"]) for r in blocks.orderBy("block").collect()] == [("u=x AND v=p", 5, 5), ("u=x AND NOT v=p", 10, 15), ("NOT u=x", 9, 24)]
    assert [r["node"] for r in placed.filter("block = 0").orderBy("place").collect()] == [9, 12, 15, 18, 21]
    density = spark.createDataFrame([(0, 0, 0.5), (0, 1, 0.1), (1, 2, 0.2)], "bi int, bj int, density double")
    big, links = post.density_plot(density, spark.createDataFrame([(0, 11), (1, 12), (2, 10)], "block int, size long"))
    assert {r["block"] for r in big.collect()} == {0, 1} and links.count() == 2
    row = spark.range(1).select(post.percent(F.lit(0.1234)).alias("p"), post.set_bits(F.lit(11).cast("long")).alias("b")).first()
    assert row["p"] == "12.3%" and row["b"] == [0, 1, 3]
    ids = nodes.select(F.col("node_id").alias("node"))
    assert post.outside(ids, ids.filter("node < 20")).count() == 4


@pytest.mark.parametrize("kind", ["uniform", "degree", "blocks"])
def test_summary_under_a_model_against_dense_cells(spark, kind):
    """Three splits; every pair of blocks gets its parameter anew from dense arrays of cells."""
    rng = np.random.default_rng(12)
    n = 36
    label = rng.integers(0, 3, n)
    cells = rng.random((n, n)) < np.where(label[:, None] == label, 0.55, 0.12)
    cells[:4] |= rng.random((4, n)) < 0.5
    cells = np.triu(cells, 1)
    cells |= cells.T
    nodes = spark.createDataFrame([(i, f"l{v}") for i, v in enumerate(label.tolist())], "node_id long, label string")
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in np.argwhere(cells)], "src long, dst long")
    held = rng.random((7, n)) < 0.45
    held[0], held[1] = label == 0, label == 1
    support = spark.createDataFrame([(int(c), int(i)) for c, i in np.argwhere(held)], "cut int, node long")
    model = M.fit(kind, nodes, edges, **({"label": "label"} if kind == "blocks" else {}))
    p = np.zeros((n, n))
    for r in model.dense().collect():
        p[r["src"], r["dst"]] = r["p"]

    def content(a, b):
        x, q = cells[np.ix_(a, b)], p[np.ix_(a, b)]
        use = (q > 0) & (np.array(a)[:, None] != np.array(b))
        k, q = x[use].sum(), q[use]
        if not len(q):
            return 0.0
        if k == 0 or k == len(q):
            return float(-np.log(1 - q if k == 0 else q).sum())
        low, high = -40.0, 40.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if (q * np.exp(mid) / (1 - q + q * np.exp(mid))).sum() < k else (low, mid)
        return float(k * low - np.log(1 - q + q * np.exp(low)).sum())

    blocks, want = {0: list(range(n))}, []
    for i in range(1, 4):
        found = []
        for b, members in blocks.items():
            for c in range(7):
                inner, outer = [v for v in members if held[c, v]], [v for v in members if not held[c, v]]
                if inner and outer:
                    new = [inner, outer, *(m for o, m in blocks.items() if o != b)]
                    size = len(new)
                    found.append((-round(sum(content(x, y) for x in new for y in new) / (size * (size + 1) / 2 + size + 50), 6), b, c, inner, outer))
        si, b, c, inner, outer = min(found)
        want.append((i, -si, c, b))
        blocks[b], blocks[i] = inner, outer
    got, done = summarize.summarize(nodes, edges, support, model)
    assert [(i, c, b) for i, _, c, b in done] == [(i, c, b) for i, _, c, b in want]
    assert np.allclose([d[1] for d in done], [w[1] for w in want], atol=2e-6)
    assert {(r["node"], r["block"]) for r in got.collect()} == {(v, b) for b, members in blocks.items() for v in members}


@pytest.mark.parametrize("kind", ["degree", "blocks"])
def test_pairs_mined_for_three_rounds_against_dense_cells(spark, kind):
    """The best pair of each round, from dense cells that every stored pair shifts in both orientations."""
    nodes, edges, a = graph(spark, n=30, seed=8)
    selectors = [Nominal("u", v) for v in "xy"] + [Nominal("v", w) for w in "pqr"]
    model = M.fit(kind, nodes, edges, **({"label": "u"} if kind == "blocks" else {}))
    p = np.zeros((30, 30))
    for r in model.dense().collect():
        p[r["src"], r["dst"]] = r["p"]
    rows = nodes.collect()
    own = {s.descr: np.array([str(r[s.attribute]) == s.value for r in rows]) for s in selectors}
    want = []
    for i in range(3):
        found = []
        for d, x in own.items():
            for e, y in own.items():
                cells = np.outer(x, y) & ~np.eye(30, dtype=bool)
                k, n, q = a[cells].sum(), cells.sum(), p[cells].sum()
                if d != e and n:
                    term = lambda v, w: v * np.log(v / w) if v else 0.0
                    found.append((-round((term(k, q) + term(n - k, n - q)) / (0.3 * 2 + 0.5), 6), d, e, int(n), int(k), q))
        quality, d, e, n, k, q = min(found)
        times = np.outer(own[d], own[e]).astype(float) + np.outer(own[e], own[d])
        cells = np.outer(own[d], own[e]) & ~np.eye(30, dtype=bool)
        odds = p / (1 - p)
        low, high = -30.0, 30.0
        for _ in range(200):
            mid = (low + high) / 2
            now = odds * np.exp(mid * times)
            low, high = (mid, high) if (now / (1 + now))[cells].sum() < k else (low, mid)
        now = odds * np.exp(low * times)
        p = np.where(times > 0, now / (1 + now), p)
        want.append((i + 1, d, e, n, k, round(q, 5), round(-quality, 5), round(low, 4)))
    got, _ = mining.mine_pairs(nodes, edges, search.Task(selectors, size=20, depth=1), model, rounds=3, outer=20)
    assert [(*tuple(r)[:5], round(r["expected"], 5), round(r["quality"], 5), round(r["lambda"], 4)) for r in got.collect()] == want


def test_margins_of_twenty_thousand_joint_classes():
    """Five times as many classes as the table of class pairs may have; margins are met to a millionth."""
    rng = np.random.default_rng(1)
    classes = rng.choice(200 * 220, 20_000, replace=False)
    out, in_, n = classes // 220, classes % 220, rng.integers(1, 4, 20_000)
    gap = int((out * n).sum() - (in_ * n).sum())
    extra = np.flatnonzero((n == 1) & ((in_ if gap > 0 else out) < 100))[: abs(gap)]
    (in_ if gap > 0 else out)[extra] += 1 + (np.arange(len(extra)) < abs(gap) - len(extra))
    side = in_ if gap > 0 else out
    while (left := abs(int((out * n).sum() - (in_ * n).sum()))) > 0:
        more = extra[:left]
        side[more] += 1
    a, b = prior.fit_margins(out, in_, n)
    r, ri = np.unique(out, return_inverse=True)
    k, ki = np.unique(in_, return_inverse=True)
    ar, bk = np.empty(len(r)), np.empty(len(k))
    ar[ri], bk[ki] = a, b
    p = prior.sigmoid(np.maximum(ar[:, None] + bk, -700))
    rows, columns = np.bincount(ri, n), np.bincount(ki, n)
    own = n * prior.sigmoid(np.maximum(a + b, -700))
    assert np.abs((p @ columns * rows - np.bincount(ri, own)) / rows - r).max() < 1e-6
    assert np.abs((rows @ p * columns - np.bincount(ki, own)) / columns - k).max() < 1e-6


def test_directed_margins_as_a_model(spark):
    """Cells meet both margins, groups expect the sum of their cells, and a search takes the model."""
    nodes, edges, a = graph(spark, n=26, seed=5, directed=True)
    model = M.directed(nodes, edges)
    p = np.zeros(a.shape)
    every = nodes.select(F.col("node_id").alias("src")).crossJoin(nodes.select(F.col("node_id").alias("dst")))
    for r in model.cells(every).collect():
        p[r["src"], r["dst"]] = r["p"]
    for axis in (0, 1):
        for d in np.unique(a.sum(axis)):
            assert abs(p.sum(axis)[a.sum(axis) == d].sum() - a.sum(axis)[a.sum(axis) == d].sum()) < 1e-6
    selectors = [Nominal("u", "x"), Nominal("u", "y"), Nominal("v", "q")]
    got = {r["sg"]: r["p"] for r in model.expected(cover(nodes, "node_id", selectors)).collect()}
    rows = nodes.collect()
    for i, s in enumerate(selectors):
        own = np.array([r[s.attribute] == s.value for r in rows])
        assert abs(got[i] - p[np.ix_(own, own)].sum()) < 1e-9
    assert search.beam_graph(nodes, edges, search.Task(selectors, size=3), search.si_model, 26, int(a.sum()), model=model).count() > 0


def weighted(spark, family, n=18):
    """A directed graph of weights, of which node 3 has none outgoing, and its dense matrix."""
    rng = np.random.default_rng(11)
    w = (rng.random((n, n)) < 0.6) * (1.0 if family == "bernoulli" else rng.integers(1, 6, (n, n)).astype(float))
    w[3] = 0
    np.fill_diagonal(w, 0)
    nodes = spark.createDataFrame([(i, "xy"[i < 7], "pqr"[i % 3]) for i in range(n)], "node_id long, u string, v string")
    edges = spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w), strict=True)], "src long, dst long, weight double")
    return nodes, edges, w


LOG_PARTITION = {"bernoulli": lambda x: np.log1p(np.exp(x)), "geometric": lambda x: -np.log(1 - np.exp(x)), "exponential": lambda x: -np.log(-x)}
PARAMETER = {"bernoulli": lambda m: np.log(m / (1 - m)), "geometric": lambda m: np.log(m / (1 + m)), "exponential": lambda m: -1 / m}


@pytest.mark.parametrize("family", ["bernoulli", "geometric", "exponential"])
@pytest.mark.parametrize("make", [M.directed, M.degree])
def test_weighted_models_against_dense(spark, family, make):
    nodes, edges, w = weighted(spark, family)
    m = make(nodes, edges, family=family, weight="weight", **({} if make is M.directed else {"undirected": False}))
    pairs = nodes.select(F.col("node_id").alias("src")).crossJoin(nodes.select(F.col("node_id").alias("dst")))
    p = np.zeros_like(w)
    for r in m.cells(pairs).collect():
        p[r["src"], r["dst"]] = r["p"]
    for axis in (0, 1):  # met in sum over the nodes of the same sum of weights
        sums = w.sum(axis)
        for v in np.unique(sums):
            assert abs((p.sum(axis) - sums)[sums == v].sum()) < 1e-6
    member = np.arange(len(w)) < 7
    got = {r["sg"]: r["p"] for r in m.expected(cover(nodes, "node_id", [Nominal("u", "y"), Nominal("u", "x")])).collect()}
    assert abs(got[0] - p[np.ix_(member, member)].sum()) < 1e-8 and abs(got[1] - p[np.ix_(~member, ~member)].sum()) < 1e-8
    seen = m.likelihood(pairs.join(edges, ["src", "dst"], "left"))
    like = {(r["src"], r["dst"]): r["log_likelihood"] for r in seen.collect()}
    assert len(like) == w.size and all(like[i, i] == 0 for i in range(len(w))) and all(x == 0 for (i, _), x in like.items() if i == 3)
    for i, j in [(0, 1), (1, 0), (5, 9), (9, 17), (17, 2)]:
        x = PARAMETER[family](p[i, j])
        assert abs(like[i, j] - (w[i, j] * x - LOG_PARTITION[family](x))) < 1e-8
    never = m.likelihood(spark.createDataFrame([(3, 5, 2.0), (4, 4, 1.0)], "src long, dst long, weight double")).collect()
    assert [r["log_likelihood"] for r in never] == [float("-inf")] * 2


@pytest.mark.parametrize("family", ["geometric", "exponential"])
@pytest.mark.parametrize("factor", [0.3, 1.0, 4.0])
def test_weighted_patterns(spark, tmp_path, family, factor):
    nodes, edges, w = weighted(spark, family)
    m = M.degree(nodes, edges, undirected=False, family=family, weight="weight")
    p = dense(m, len(w))
    left, right = (nodes.filter(c).select(F.col("node_id").alias("node")) for c in ("node_id < 9", "node_id between 6 and 12"))
    k = factor * w[:9, 6:13].sum()
    once, shift, before, gain = m.pattern(left, right, k)
    q = dense(once, len(w))
    assert abs(before - p[:9, 6:13].sum()) < 1e-8 and abs(q[:9, 6:13].sum() - k) < 1e-5 and np.allclose(q[9:], p[9:]) and np.allclose(q[:, :6], p[:, :6])
    some = np.argwhere(p[:9, 6:13] > 0) + [0, 6]
    x, y = (PARAMETER[family](t[some[:, 0], some[:, 1]]) for t in (p, q))
    assert np.allclose(y - x, shift) and abs(gain - (k * shift - (LOG_PARTITION[family](y) - LOG_PARTITION[family](x)).sum())) < 1e-6 and gain > -1e-9
    once.save(str(tmp_path / "weights"))
    again = M.Background.load(spark, str(tmp_path / "weights"))
    assert again.family == family and np.allclose(dense(again, len(w)), q)
    assert np.isfinite(m.pattern(left, right, 0)[1:]).all()
    groups = cover(nodes, "node_id", [Nominal("u", "x"), Nominal("v", "q")])
    got = {r["sg"]: tuple(r)[2:] for r in m.contents(groups, spark.createDataFrame([(0, 40.0), (1, 21.0)], "sg int, k double")).collect()}
    for i, (c, k) in enumerate([("u = 'x'", 40.0), ("v = 'q'", 21.0)]):
        _, shift, before, gain = m.pattern(nodes.filter(c).select(F.col("node_id").alias("node")), None, k)
        assert np.allclose(got[i], (before, shift, gain))


@pytest.mark.parametrize("family", ["bernoulli", "geometric", "exponential"])
def test_weights_of_twenty_thousand_nodes(family):
    rng = np.random.default_rng(5)
    o = rng.integers(0, 300, 20_000).astype(float)
    i = rng.permutation(o)
    (r, k), n = np.unique(np.stack([o, i]), axis=1, return_counts=True)
    a, b = prior.fit_weights(r, k, n, family, square=False)
    mean = {"bernoulli": lambda x: 1 / (1 + np.exp(-x)), "geometric": lambda x: 1 / np.expm1(-x), "exponential": lambda x: -1 / x}[family]
    ka, kb = (np.array([x[np.flatnonzero(v == t)[0]] for t in np.unique(v)]) for x, v in ((a, r), (b, k)))
    got = np.array([(np.bincount(k.astype(int), n)[1:] * mean(x + kb[1:])).sum() for x in ka[1:]])
    assert np.abs(got / np.unique(r)[1:] - 1).max() < 1e-6


def test_margins_that_no_model_has():
    with pytest.raises(ValueError, match="no bernoulli model"):
        prior.fit_weights(np.array([4.0, 2.0]), np.array([3.0, 2.0]), np.array([2, 2]), "bernoulli")
    with pytest.raises(ValueError, match="at least 0"):
        prior.fit_weights(np.array([-1.0]), np.array([3.0]), np.array([2]), "geometric")
