"""Registered queries over background models, mining, summaries, further targets and plot data, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevein import queries as Q0
from lodevein.functions import quality as Q
from lodevein.functions.selectors import Nominal, cover, selector_table
from lodevein.operators import graph_stats as G
from lodevein.operators import model as M
from lodevein.operators import post, prep
from lodevein.plans import mining, search, summarize
from lodevein.sources import fixtures as X
from lodevein.sources.readers import venues

_ic, GRAPH, _P, _ROWS = Q0._ic, Q0.GRAPH, Q0._P, Q0._ROWS


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return X.parts(spark, sf), X.copurchase(spark, sf)


# ---- interestingness under models --------------------------------------------------------------------------------------------


def _single(kind: str) -> Callable:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        nodes, edges = X.parts(spark, sf), M._cut(X.copurchase_once(spark, sf))
        sel = Q0.part_selectors(nodes)
        groups = cover(nodes, "node_id", sel)
        covers, between = G.by_cover(edges, groups, once=True, every=True, parts=X.pair_tasks(spark, sf))
        counts = G.group_counts(between, covers).join(M.fit(kind, nodes, edges, once=True, **({"label": "p_type"} if kind == "blocks" else {})).expected(groups), "sg")
        counts = counts.join(F.broadcast(selector_table(spark, sel)), "sg").withColumn("length", F.lit(1))
        return counts.select("descr", "n", "k", F.round("p", 2).alias("expected"), F.round(search.si_model(counts, 0, 0), 3).alias("si"))

    return run


def bi_si_degree(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of brands under the degree prior."""
    nodes, edges = X.parts(spark, sf), M._cut(X.copurchase_once(spark, sf))
    sel = [s for s in Q0.part_selectors(nodes) if s.attribute == "p_brand"]
    groups = cover(nodes, "node_id", sel)
    covers, between = G.by_cover(edges, groups, once=True, parts=X.pair_tasks(spark, sf))
    pairs = G.pair_counts(between, covers, covers).join(M.degree(nodes, edges, once=True).expected_pairs(groups, groups), ["a", "b"]).filter("a != b")
    t = selector_table(spark, sel)
    pairs = pairs.join(F.broadcast(t.select(F.col("sg").alias("a"), "descr")), "a").join(F.broadcast(t.select(F.col("sg").alias("b"), F.col("descr").alias("descr2"))), "b")
    return pairs.select("descr", "descr2", "k", "n", F.round("p", 2).alias("expected"), F.round(Q.subjective_interestingness(F.col("k"), F.col("n"), F.col("p"), 2), 3).alias("si"))


def model_row(spark: SparkSession, sf: str) -> DataFrame:
    """Probabilities of the cells of node 1 under the degree prior."""
    nodes, edges = X.parts(spark, sf), X.copurchase_once(spark, sf)
    return M.degree(nodes, edges, once=True).row(1).select("dst", F.round("p", 5).alias("p"))


#: DuckDB: parameters of the symmetric degree prior, by damped fixed-point steps over the classes of degrees.
PRIOR = f"""WITH RECURSIVE {GRAPH}, deg AS (SELECT p_partkey AS node, coalesce(c, 0)::BIGINT AS d FROM part LEFT JOIN (SELECT src AS p_partkey, count(*) AS c FROM edges GROUP BY 1) USING (p_partkey)
), cls AS (SELECT d, count(*)::DOUBLE AS n FROM deg GROUP BY 1
), it AS (
  SELECT 0 AS i, list(d ORDER BY d) AS ds, list(n ORDER BY d) AS ns, list(ln(d) - 0.5 * ln((SELECT m FROM tot)) ORDER BY d) AS xs FROM cls
  UNION ALL
  SELECT i + 1, ds, ns, list_transform(range(1, len(ds) + 1), lambda k: (xs[k] + ln(ds[k]) - ln(list_sum(list_transform(range(1, len(ds) + 1), lambda j: (ns[j] - (j = k)::INT) * exp(xs[j]) / (1 + exp(xs[k] + xs[j])))))) / 2) FROM it WHERE i < 150
), par AS (SELECT unnest(ds) AS d, unnest(xs) AS x FROM it WHERE i = 150), px AS (SELECT node, x FROM deg JOIN par USING (d)
), g AS (SELECT c.descr, c.attr, px.x, count(*)::DOUBLE AS h FROM covers c JOIN px USING (node) GROUP BY ALL
), self AS (SELECT descr, sum(h / (1 + exp(-2 * x))) AS s FROM g GROUP BY 1)"""
SINGLE_SQL = f"""{PRIOR}, e AS (SELECT a.descr, sum(a.h * b.h / (1 + exp(-a.x - b.x))) AS t FROM g a JOIN g b ON a.descr = b.descr GROUP BY 1), q AS (SELECT descr, n, k, t - s AS p FROM stats JOIN e USING (descr) JOIN self USING (descr))
SELECT descr, n::BIGINT AS n, k::BIGINT AS k, round(p, 2) AS expected, round({_ic('k', 'n * (n - 1)', 'p')} / (0.3::DOUBLE + 0.5::DOUBLE), 3) AS si FROM q"""
PAIRS_SQL = f"""{PRIOR}, kk AS (SELECT s.descr AS a, d.descr AS b, count(*) AS k FROM edges e JOIN covers s ON s.node = e.src JOIN covers d ON d.node = e.dst WHERE s.attr = 'p_brand' AND d.attr = 'p_brand' GROUP BY ALL),
q AS (SELECT x.descr, y.descr AS descr2, coalesce(any_value(kk.k), 0)::BIGINT AS k, any_value(sx.n * sy.n)::BIGINT AS n, sum(x.h * y.h / (1 + exp(-x.x - y.x))) AS p FROM g x JOIN g y ON x.descr <> y.descr AND x.attr = 'p_brand' AND y.attr = 'p_brand'
  JOIN stats sx ON sx.descr = x.descr JOIN stats sy ON sy.descr = y.descr LEFT JOIN kk ON kk.a = x.descr AND kk.b = y.descr GROUP BY x.descr, y.descr)
SELECT descr, descr2, k, n, round(p, 2) AS expected, round({_ic('k', 'n', 'p')} / (0.3::DOUBLE * 2 + 0.5::DOUBLE), 3) AS si FROM q"""

# ---- mining and summaries ------------------------------------------------------------------------------------------------------


def mining_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """The best pattern, and the best one once the model knows it."""
    nodes, edges = X.parts(spark, sf), X.copurchase_once(spark, sf)
    with G.held(edges):
        found, _ = mining.mine(nodes, edges, search.Task(Q0.part_selectors(nodes), size=5, depth=1), M.uniform(nodes, edges, once=True), rounds=2, once=True)
    return found.select("round", "descr", "n", "k", F.round("expected", 3).alias("expected"), F.round("quality", 4).alias("quality"))


MINING_SQL = f"""WITH {GRAPH}, one AS (SELECT descr, n, k, n * (n - 1) * {_P} AS p, {Q0._SI1} AS q FROM stats, tot), a AS (SELECT * FROM one ORDER BY q DESC, descr LIMIT 1),
c AS (SELECT descr, count(*)::DOUBLE AS c FROM covers WHERE node IN (SELECT node FROM covers JOIN a USING (descr)) GROUP BY 1),
two AS (SELECT s.descr, s.n, s.k, (s.n * (s.n - 1) - coalesce(c * (c - 1), 0)) * {_P} + coalesce(c * (c - 1), 0) * a.k / (a.n * (a.n - 1)) AS p FROM stats s LEFT JOIN c USING (descr), a, tot),
b AS (SELECT *, round({_ic('k', 'n * (n - 1)', 'p')} / (0.3::DOUBLE * 1 + 0.5::DOUBLE), 6) AS q FROM two ORDER BY q DESC, descr LIMIT 1)
SELECT 1::INT AS round, descr, n::BIGINT AS n, k::BIGINT AS k, round(p, 3) AS expected, round(q, 4) AS quality FROM a UNION ALL SELECT 2::INT, descr, n::BIGINT, k::BIGINT, round(p, 3), round(q, 4) FROM b"""


def mining_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The pair of subgroups whose mutual edges surprise most, and the best pair once the model knows it."""
    nodes, edges = X.parts(spark, sf), X.copurchase_once(spark, sf)
    with G.held(edges):
        found, _ = mining.mine_pairs(nodes, edges, search.Task(Q0.part_selectors(nodes), size=5, depth=1), M.uniform(nodes, edges, once=True), rounds=2, once=True)
    return found.select("round", "descr", "descr2", "n", "k", F.round("expected", 3).alias("expected"), F.round("quality", 4).alias("quality"))


#: Cells of the stored pair shift once, those that lie in both orientations of it twice; the parameter comes from Newton's steps.
MINING_PAIRS_SQL = f"""
WITH RECURSIVE {GRAPH}, sizes AS (SELECT descr, count(*)::DOUBLE AS n FROM covers GROUP BY ALL),
kk AS (SELECT s.descr AS a, d.descr AS b, count(*) AS k FROM edges e JOIN covers s ON s.node = e.src JOIN covers d ON d.node = e.dst GROUP BY ALL),
cc AS (SELECT s.descr AS a, d.descr AS b, count(*) AS c FROM covers s JOIN covers d ON s.node = d.node GROUP BY ALL),
base AS (SELECT x.descr, y.descr AS descr2, coalesce(k, 0)::DOUBLE AS k, x.n * y.n - coalesce(c, 0) AS n, {_P} AS p FROM sizes x JOIN sizes y ON x.descr <> y.descr LEFT JOIN kk ON kk.a = x.descr AND kk.b = y.descr LEFT JOIN cc ON cc.a = x.descr AND cc.b = y.descr CROSS JOIN tot),
one AS (SELECT *, round({_ic('k', 'n', 'n * p')} / (0.3::DOUBLE * 2 + 0.5::DOUBLE), 6) AS q FROM base), first_ AS (SELECT * FROM one ORDER BY q DESC, descr, descr2 LIMIT 1),
flags AS (SELECT p_partkey AS node, ('p_brand=' || p_brand = f.descr OR 'p_type=' || p_type = f.descr)::INT AS ia, ('p_brand=' || p_brand = f.descr2 OR 'p_type=' || p_type = f.descr2)::INT AS ib FROM part, first_ f),
two_ AS (SELECT f.p / (1 - f.p) AS o, f.k, f.n - z.c * (z.c - 1) AS n1, z.c * (z.c - 1) AS n2 FROM first_ f, (SELECT sum(ia * ib)::DOUBLE AS c FROM flags) z),
newton AS (SELECT 0 AS i, 1.0::DOUBLE AS f, o, k, n1, n2 FROM two_
  UNION ALL SELECT i + 1, f * exp((k - n1 * o * f / (1 + o * f) - n2 * o * f * f / (1 + o * f * f)) / (n1 * o * f / pow(1 + o * f, 2) + 2 * n2 * o * f * f / pow(1 + o * f * f, 2))), o, k, n1, n2 FROM newton WHERE i < 20),
now AS (SELECT o * f / (1 + o * f) AS q1, o * f * f / (1 + o * f * f) AS q2 FROM newton WHERE i = 20),
own AS (SELECT descr, sum(ia)::DOUBLE AS a, sum(ib)::DOUBLE AS b, sum(ia * ib)::DOUBLE AS ab FROM covers JOIN flags USING (node) GROUP BY 1),
mid AS (SELECT s.descr, d.descr AS descr2, sum(ia * ib)::DOUBLE AS dd FROM covers s JOIN covers d USING (node) JOIN flags USING (node) GROUP BY ALL),
hit AS (SELECT o.*, x.a * y.b + x.b * y.a - 2 * x.ab * y.ab AS x1, x.ab * y.ab - coalesce(dd, 0) AS x2 FROM one o JOIN own x ON x.descr = o.descr JOIN own y ON y.descr = o.descr2 LEFT JOIN mid m ON m.descr = o.descr AND m.descr2 = o.descr2),
next_ AS (SELECT descr, descr2, k, n, (n - x1 - x2) * p + x1 * q1 + x2 * q2 AS p FROM hit, now),
second_ AS (SELECT *, round({_ic('k', 'n', 'p')} / (0.3::DOUBLE * 2 + 0.5::DOUBLE), 6) AS q FROM next_ ORDER BY q DESC, descr, descr2 LIMIT 1)
SELECT 1::INT AS round, descr, descr2, n::BIGINT AS n, k::BIGINT AS k, round(n * p, 3) AS expected, round(q, 4) AS quality FROM first_ UNION ALL SELECT 2::INT, descr, descr2, n::BIGINT, k::BIGINT, round(p, 3), round(q, 4) FROM second_"""


def summary_degree(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the first split by every brand under the degree prior."""
    nodes, edges = X.parts(spark, sf), X.copurchase_once(spark, sf)
    support, sel = Q0._brand_support(nodes)
    with G.held(edges):
        model = M.degree(nodes, edges, once=True)
        blocks = nodes.select(F.col("node_id").alias("node"), F.lit(0).alias("block"))
        scores = summarize.split_scores(edges, blocks, support, model, {}, once=True)
        return scores.join(F.broadcast(selector_table(spark, sel)), scores["cut"] == F.col("sg")).select("descr", F.round("si", 3).alias("si"))


#: Each of the four pairs of blocks gets its parameter by Newton's steps over the pairs of degree classes.
SUMMARY_DEGREE_SQL = f"""{PRIOR}, c AS (SELECT descr, x, h FROM g WHERE attr = 'p_brand'), u AS (SELECT x, count(*)::DOUBLE AS h FROM px GROUP BY 1),
side AS (SELECT d.descr, u.x, coalesce(c.h, 0) AS a, u.h - coalesce(c.h, 0) AS b FROM (SELECT DISTINCT descr FROM c) d CROSS JOIN u LEFT JOIN c ON c.descr = d.descr AND c.x = u.x),
cell AS (
  SELECT s.descr, part, CASE part WHEN 0 THEN s.a * t.a - CASE WHEN s.x = t.x THEN s.a ELSE 0 END WHEN 1 THEN s.a * t.b WHEN 2 THEN s.b * t.a ELSE s.b * t.b - CASE WHEN s.x = t.x THEN s.b ELSE 0 END END AS w, exp(s.x + t.x) AS o
  FROM side s JOIN side t ON s.descr = t.descr CROSS JOIN range(4) r(part)),
want AS (SELECT descr, part, CASE part WHEN 0 THEN k WHEN 1 THEN o - k WHEN 2 THEN i - k ELSE (SELECT m FROM tot) - o - i + k END::DOUBLE AS k FROM stats CROSS JOIN range(4) r(part) WHERE attr = 'p_brand'),
odds AS (SELECT descr, part, o, sum(w) AS w FROM cell WHERE w > 0 GROUP BY ALL),
lists AS (SELECT descr, part, list(o) AS os, list(w) AS ws FROM odds GROUP BY ALL),
newton AS (
  SELECT descr, part, os, ws, k, 0 AS i, 1.0::DOUBLE AS f FROM lists JOIN want USING (descr, part)
  UNION ALL
  SELECT descr, part, os, ws, k, i + 1, f * exp(greatest(-1.0, least(1.0,
    (k - list_sum(list_transform(range(1, len(os) + 1), lambda j: ws[j] * os[j] * f / (1 + os[j] * f)))) / list_sum(list_transform(range(1, len(os) + 1), lambda j: ws[j] * os[j] * f / pow(1 + os[j] * f, 2)))))) FROM newton WHERE i < 14
), ic AS (SELECT descr, CASE WHEN k = 0 THEN list_sum(list_transform(range(1, len(os) + 1), lambda j: ws[j] * ln(1 + os[j]))) ELSE k * ln(f) - list_sum(list_transform(range(1, len(os) + 1), lambda j: ws[j] * ln((1 + os[j] * f) / (1 + os[j])))) END AS v FROM newton WHERE i = 14)
SELECT descr, round(sum(v) / 55, 3) AS si FROM ic GROUP BY 1"""


def summary_contents(spark: SparkSession, sf: str) -> DataFrame:
    """Parameter and information content of every pair of part types under the uniform prior."""
    nodes, once = X.parts(spark, sf), M._cut(X.copurchase_once(spark, sf))
    edges = X.mirrored(once)
    blocks = nodes.select(F.col("node_id").alias("node"), F.col("p_type").alias("block"))
    found = mining.block_contents(edges, blocks, M.uniform(nodes, once, once=True))
    return found.select("bi", "bj", "k", "n", F.round("expected", 3).alias("expected"), F.round("lambda", 5).alias("lambda"), F.round("ic", 4).alias("ic"))


CONTENTS_SQL = Q0.BLOCK_SQL.split("SELECT bi, bj, k, n, round(")[0] + f"SELECT bi, bj, k, n, round(n * {_P}, 3) AS expected, round(ln(k::DOUBLE / (n - k)) - ln({_P} / (1 - {_P})), 5) AS lambda, round({_ic('k', 'n', f'n * {_P}')}, 4) AS ic FROM g, tot"


def summary_replay(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks after two splits: by a brand, and the rest by a type."""
    nodes = X.parts(spark, sf)
    sel = Q0.part_selectors(nodes)
    brand = min((i for i, s in enumerate(sel) if s.attribute == "p_brand"), key=lambda i: sel[i].descr)
    kind = min((i for i, s in enumerate(sel) if s.attribute == "p_type"), key=lambda i: sel[i].descr)
    return mining.replay(nodes, sel, [(brand, 0), (kind, 1)], order="p_retailprice")[0]


REPLAY_SQL = """WITH b AS (SELECT min(p_brand) AS b, min(p_type) AS t FROM part), c AS (SELECT CASE WHEN p_brand = b THEN 0 WHEN p_type = t THEN 1 ELSE 2 END::INT AS block FROM part, b), s AS (SELECT block, count(*)::BIGINT AS size FROM c GROUP BY 1)
SELECT block, CASE block WHEN 0 THEN 'p_brand=' || b WHEN 1 THEN 'NOT p_brand=' || b || ' AND p_type=' || t ELSE 'NOT p_brand=' || b || ' AND NOT p_type=' || t END AS descr, size, sum(size) OVER (ORDER BY block)::BIGINT AS upto FROM s, b"""

# ---- further targets -------------------------------------------------------------------------------------------------------------


def sd_ga_numeric(spark: SparkSession, sf: str) -> DataFrame:
    """Mean price of pairs of conditions over the best mean of their parts."""
    data, sel = Q0.line_data(spark, sf)
    pairs = [(i, j) for i in range(len(sel)) for j in range(i + 1, len(sel)) if sel[i].attribute != sel[j].attribute]
    c = search.Candidates(sel, [(i,) for i in range(len(sel))] + pairs)
    n, mean = data.select(F.count("*"), F.avg("l_extendedprice")).first()
    counts = search.target_counts(data, "l_orderkey", c, F.col("l_extendedprice"), numeric=True).join(F.broadcast(c.table(spark)), "sg")
    return search.generalisation_aware(counts, c, 0.5, n, mean, "mean_sg").select("descr", F.round("quality", 4).alias("quality"))


GA_NUMERIC_SQL = f"""WITH {_ROWS}, pairs AS (
  SELECT a, b, x FROM (SELECT rid, x, unnest(ids) AS a FROM rowsx) JOIN (SELECT rid, unnest(ids) AS b FROM rowsx) USING (rid) WHERE a < b
), p AS (SELECT a, b, count(*)::DOUBLE AS n_sg, avg(x) AS mean_sg FROM pairs GROUP BY ALL)
SELECT descr, round(sqrt(n_sg / nn) * (mean_sg - mean), 4) AS quality FROM lv, tot
UNION ALL SELECT p.a || ' AND ' || p.b, round(sqrt(p.n_sg / nn) * (p.mean_sg - greatest(x.mean_sg, y.mean_sg, mean)), 4) FROM p JOIN lv x ON x.descr = a JOIN lv y ON y.descr = b, tot"""


def sd_chi_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """Chi-squared of weighted counts, times the effective sample size over the sum of weights; and with Yates' correction."""
    data = X.table(spark, sf, "lineitem")
    ess = data.agg(post.effective_sample_size(F.col("l_quantity").cast("double"))).first()[0]
    counts = Q0._nominal_counts(spark, sf, "l_quantity").withColumn("ess", F.lit(float(ess)))
    args = [F.col(c) for c in ("n", "pos", "n_sg", "pos_sg")]
    scale = F.col("ess") / F.col("n")
    return counts.select("descr", F.round(Q.chi_squared(*args) * scale, 4).alias("quality"), F.round(Q.chi_squared(*args, yates=True) * scale, 4).alias("corrected"))


_GAP = "abs(wpos_sg * (ww - w_sg - wpos + wpos_sg) - (wpos - wpos_sg) * (w_sg - wpos_sg))"
_MARGINS = "(wpos * (ww - wpos) * w_sg * (ww - w_sg))"
CHI_SQL = f"""WITH {_ROWS}, s AS (SELECT power(sum(w), 2) / sum(w * w) AS ess FROM rowsx)
SELECT descr, round(ww * power({_GAP}, 2) / {_MARGINS} * ess / ww, 4) AS quality, round(ww * power(greatest({_GAP} - ww / 2, 0), 2) / {_MARGINS} * ess / ww, 4) AS corrected FROM lv, tot, s"""


def sd_numeric_top_k(spark: SparkSession, sf: str) -> DataFrame:
    data, sel = Q0.line_data(spark, sf)
    sel = [s for s in sel if s.attribute != "l_quantity"]
    found = search.numeric_search(data, "l_orderkey", search.Task(sel, size=10, depth=2), F.col("l_quantity"), 0.5)
    return found.select("rank", F.round("quality", 4).alias("quality"), "descr", "n")


NUMERIC_SQL = f"""WITH {_ROWS}, u AS (SELECT rid, w, unnest(ids) AS a FROM rowsx), v AS (SELECT * FROM u WHERE a NOT LIKE 'l_quantity%'), mm AS (SELECT avg(w) AS mean FROM rowsx),
alls AS (SELECT a AS descr, count(*)::DOUBLE AS n, avg(w) AS m FROM v GROUP BY 1 UNION ALL SELECT x.a || ' AND ' || y.a, count(*)::DOUBLE, avg(x.w) FROM v x JOIN v y ON x.rid = y.rid AND x.a < y.a GROUP BY x.a, y.a),
q AS (SELECT descr, n, round(sqrt(n) * (m - mean), 6) AS quality FROM alls, mm)
SELECT row_number() OVER (ORDER BY quality DESC, descr)::INT AS rank, round(quality, 4) AS quality, descr, n::BIGINT AS n FROM (SELECT * FROM q WHERE quality > 0 ORDER BY quality DESC, descr LIMIT 10)"""

# ---- sources, tables and plot data ----------------------------------------------------------------------------------------------


def synthetic_graphs(spark: SparkSession, sf: str) -> DataFrame:
    """Edges inside the groups of every attribute of three small graphs."""
    out = None
    for name, (nodes, edges) in {"old": X.old_synthetic(spark), "new": X.new_synthetic(spark), "two_sided": X.two_sided_synthetic(spark)}.items():
        sel = [Nominal(c, 1) for c in nodes.columns if c != "node_id"]
        counts = G.group_counts(edges, cover(nodes, "node_id", sel)).join(selector_table(spark, sel), "sg").select(F.lit(name).alias("graph"), "descr", "n", "k")
        out = counts if out is None else out.union(counts)
    return out


def venue_table(spark: SparkSession, sf: str) -> DataFrame:
    return venues(spark, "dblp_four_areas").groupBy("area").agg(F.count("*").alias("n"))


def dense_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Orders by number from 0."""
    return prep.ranked(X.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", "rank")


def dbscan_clusters(spark: SparkSession, sf: str) -> DataFrame:
    pts = X.table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 40).alias("y"))
    return prep.dbscan(pts, "p_partkey", ["x", "y"], 1.0, 3)


def result_statistics(spark: SparkSession, sf: str) -> DataFrame:
    counts = Q0._nominal_counts(spark, sf)
    found = Q0.SDQ["sd_wracc"](spark, sf).withColumn("rank", F.lit(0))
    t = post.result_table(found, counts)
    return post.sg_bars(t, dynamic=True).select("descr", *[F.round(c, 9).alias(c) for c in ("share_sg", "share_complement", "width_sg", "width_complement")])


def np_space(spark: SparkSession, sf: str) -> DataFrame:
    return post.np_space(Q0._nominal_counts(spark, sf))


def roc_grid(spark: SparkSession, sf: str) -> DataFrame:
    n, pos = X.table(spark, sf, "lineitem").select(F.count("*"), F.count_if(F.col("l_returnflag") == "R")).first()
    return post.rounded(post.roc_grid(spark, n, pos, 0.5, 20), {"fpr": 6, "tpr": 6, "quality": 6})


def price_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return post.histogram(X.parts(spark, sf), "p_size", "p_type", 10, 0.0, 50.0)


def block_members(spark: SparkSession, sf: str) -> DataFrame:
    """Part types in blocks of large, middle and small parts, with exact tests."""
    parts = X.parts(spark, sf)
    blocks = parts.select(F.col("node_id").alias("node"), F.least(F.floor(F.col("p_size") / 20), F.lit(2)).cast("int").alias("block"))
    return post.block_histogram(blocks, parts.select(F.col("node_id").alias("node"), F.col("p_type").alias("label"))).select("block", "label", "n", F.round("p", 6).alias("p"))


def bit_places(spark: SparkSession, sf: str) -> DataFrame:
    c = X.table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").cast("long").alias("x"))
    return c.select("c_custkey", post.set_bits(F.col("x")).alias("bits"), post.ordered_intersection(post.set_bits(F.col("x")), F.array(*map(F.lit, (0, 2, 4, 6)))).alias("even"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [bi_si_degree, model_row, mining_rounds, mining_pairs, summary_degree, summary_contents, summary_replay, sd_ga_numeric, sd_chi_weighted, sd_numeric_top_k, synthetic_graphs, venue_table, dense_ids, dbscan_clusters, result_statistics, np_space, roc_grid, price_histogram, block_members, bit_places]
    return {**{f.__name__: f for f in own}, **{f"sgd_si_{k}": _single(k) for k in ("degree", "blocks")}}


def _small(name: str, pairs: list, columns: dict) -> str:
    attrs = " UNION ALL ".join(f"SELECT '{c}=1' AS descr, unnest({[i for i, x in enumerate(v) if x]}) AS node" for c, v in columns.items())
    edges = ", ".join(f"({a}, {b})" for a, b in sorted(set(pairs)))
    return f"SELECT '{name}' AS graph, descr, n, k FROM (WITH c AS ({attrs}), e(src, dst) AS (VALUES {edges}) SELECT descr, count(*)::BIGINT AS n, (SELECT count(*) FROM e JOIN c s ON s.node = e.src JOIN c d ON d.node = e.dst AND d.descr = s.descr WHERE s.descr = c.descr)::BIGINT AS k FROM c GROUP BY descr)"


def oracle_sql() -> dict[str, str]:
    both = lambda p: p + [(b, a) for a, b in p]
    old, new = X._compressed(X.OLD_ROWS, X.OLD_COLUMNS), X._compressed(X.NEW_ROWS, X.NEW_COLUMNS)
    share = "pos_sg / n_sg AS share_sg, (pos - pos_sg) / nullif(nn - n_sg, 0) AS share_complement, 0.02::DOUBLE + 0.8::DOUBLE * n_sg / nn AS width_sg"
    return {
        "sgd_si_degree": SINGLE_SQL,
        "bi_si_degree": PAIRS_SQL,
        "model_row": f"{PRIOR} SELECT b.node AS dst, round(CASE WHEN b.node = 1 THEN 0 ELSE 1 / (1 + exp(-a.x - b.x)) END, 5) AS p FROM px a, px b WHERE a.node = 1",
        "mining_rounds": MINING_SQL,
        "mining_pairs": MINING_PAIRS_SQL,
        "summary_degree": SUMMARY_DEGREE_SQL,
        "summary_contents": CONTENTS_SQL,
        "summary_replay": REPLAY_SQL,
        "sd_ga_numeric": GA_NUMERIC_SQL,
        "sd_chi_weighted": CHI_SQL,
        "sd_numeric_top_k": NUMERIC_SQL,
        "synthetic_graphs": " UNION ALL ".join([_small("old", both(old), X.OLD_ATTRIBUTES), _small("new", both(new), X.NEW_ATTRIBUTES), _small("two_sided", [(a, b) for a, bs in X.TWO_SIDED.items() for b in bs], X.TWO_SIDED_ATTRIBUTES)]),
        "venue_table": "SELECT unnest(['ML', 'DB', 'IR', 'DM']) AS area, 5::BIGINT AS n EXCEPT SELECT 'IR', 5 EXCEPT SELECT 'DM', 5 UNION ALL SELECT 'IR', 4 UNION ALL SELECT 'DM', 6",
        "dense_ids": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rank FROM orders",
        "result_statistics": f"WITH {_ROWS}, s AS (SELECT descr, {share} FROM lv, tot) SELECT descr, round(share_sg, 9) AS share_sg, round(share_complement, 9) AS share_complement, round(width_sg, 9) AS width_sg, round(0.8::DOUBLE - width_sg, 9) AS width_complement FROM s",
        "np_space": f"WITH {_ROWS} SELECT descr, n_sg - pos_sg AS negatives, pos_sg AS positives FROM lv",
        "roc_grid": "WITH t AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (WHERE l_returnflag = 'R')::DOUBLE AS pos FROM lineitem), g AS (SELECT 0.01::DOUBLE + i * (0.98::DOUBLE / 19) AS f, 0.01::DOUBLE + j * (0.98::DOUBLE / 19) AS t2 FROM range(20) a(i), range(20) b(j)), s AS (SELECT f, t2, n, pos, f * (n - pos) + t2 * pos AS ns, t2 * pos AS ps FROM g, t) SELECT round(f, 6) AS fpr, round(t2, 6) AS tpr, round(sqrt(ns / n) * (ps / ns - pos / n), 6) AS quality FROM s",
        "price_histogram": "SELECT p_type, least(floor(p_size::DOUBLE / 5), 9)::INT AS bin, count(*)::BIGINT AS n FROM part WHERE p_size BETWEEN 0 AND 50 GROUP BY ALL",
        "block_members": """WITH x AS (SELECT least(floor(p_size / 20.0), 2)::INT AS block, p_type AS label FROM part), t AS (SELECT count(*) AS n FROM x), r AS (SELECT block, count(*)::BIGINT AS r FROM x GROUP BY 1), c AS (SELECT label, count(*)::BIGINT AS s FROM x GROUP BY 1),
o AS (SELECT r.block, c.label, r, s, n, (SELECT count(*) FROM x WHERE x.block = r.block AND x.label = c.label)::BIGINT AS a FROM r, c, t), k AS (SELECT *, unnest(range(greatest(0, r + s - n), least(r, s) + 1)) AS k FROM o),
p AS (SELECT *, exp(lgamma(r + 1) + lgamma(n - r + 1) + lgamma(s + 1) + lgamma(n - s + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(r - k + 1) - lgamma(s - k + 1) - lgamma(n - r - s + k + 1)) AS pr FROM k), z AS (SELECT block, label, pr AS po FROM p WHERE k = a)
SELECT block, label, any_value(a) AS n, round(least(sum(pr) FILTER (WHERE pr <= po * (1 + 1e-7)), 1), 6) AS p FROM p JOIN z USING (block, label) GROUP BY ALL""",
        "bit_places": "WITH b AS (SELECT c_custkey, list_filter(range(0, 63), lambda i: (c_custkey::BIGINT >> i::INT) & 1 = 1) AS bits FROM customer) SELECT c_custkey, list_transform(bits, lambda i: i::INT) AS bits, list_filter(list_transform(bits, lambda i: i::INT), lambda i: i IN (0, 2, 4, 6)) AS even FROM b",
    }
