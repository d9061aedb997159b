"""Registered queries of the graph and subgroup engine, with the SQL that each is checked against."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevein.functions import quality as Q
from lodevein.functions.selectors import Interval, Nominal, Selector, cover, create_selectors, equal_frequency_cuts, frequency_cuts, nominal_selectors, numeric_selectors, selector_table
from lodevein.operators import graph_stats as G
from lodevein.operators import post, prep, prior
from lodevein.operators.model import _cut
from lodevein.plans import search, summarize
from lodevein.sources import fixtures as X
from lodevein.sources.readers import coordinates

#: DuckDB: the part co-purchase graph and its level-1 groups.
GRAPH = """edges AS (
  SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_partkey <> b.l_partkey
), tot AS (SELECT (SELECT count(*) FROM part) AS nn, (SELECT count(*) FROM edges) AS m),
covers AS (
  SELECT p_partkey AS node, 'p_brand=' || p_brand AS descr, 'p_brand' AS attr FROM part UNION ALL SELECT p_partkey, 'p_type=' || p_type, 'p_type' FROM part
), stats AS (
  SELECT c.descr, c.attr, c.n, coalesce(k.k, 0) AS k, coalesce(o.o, 0) AS o, coalesce(i.i, 0) AS i
  FROM (SELECT descr, attr, count(*) AS n FROM covers GROUP BY ALL) c
  LEFT JOIN (SELECT s.descr, count(*) AS k FROM edges e JOIN covers s ON s.node = e.src JOIN covers d ON d.node = e.dst AND d.descr = s.descr GROUP BY 1) k USING (descr)
  LEFT JOIN (SELECT descr, count(*) AS o FROM edges JOIN covers ON node = src GROUP BY 1) o USING (descr)
  LEFT JOIN (SELECT descr, count(*) AS i FROM edges JOIN covers ON node = dst GROUP BY 1) i USING (descr)
)"""


def _ic(k: str, n: str, p: str) -> str:
    """Information content; n > 0 and 0 < p < n."""
    k, n, p = f"({k})::DOUBLE", f"({n})::DOUBLE", f"({p})"
    return f"(CASE WHEN {n} = 0 THEN 0 ELSE CASE WHEN {k} = 0 THEN 0 ELSE {k} * ln({k} / {p}) END + CASE WHEN {n} - {k} = 0 THEN 0 ELSE ({n} - {k}) * ln(({n} - {k}) / ({n} - {p})) END END)"


_P = "(m::DOUBLE / (nn * (nn - 1)))"
_SI1 = f"round({_ic('k', 'n * (n - 1)', f'n * (n - 1) * {_P}')} / (0.3::DOUBLE * 1 + 0.5::DOUBLE), 6)"


def part_selectors(nodes: DataFrame) -> list[Selector]:
    return [s for c in ("p_brand", "p_type") for s in nominal_selectors(nodes, c)]


def _counts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, list[Selector]]:
    """Nodes, edges (once) and counts of part_selectors, from the parts of one cover as one."""
    nodes, edges = X.parts(spark, sf), X.copurchase_once(spark, sf)
    sel = part_selectors(nodes)
    groups, between = G.by_cover(edges, cover(nodes, "node_id", sel), once=True, every=True, parts=X.pair_tasks(spark, sf))
    return nodes, edges, G.group_counts(between, groups).join(F.broadcast(selector_table(spark, sel)), "sg"), sel


def _measure(expr: Callable[[], object], with_totals: bool = False) -> Callable:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        nodes, edges, counts, _ = _counts(spark, sf)
        if with_totals:
            n, m = G.totals(nodes, edges, once=True)
            counts = counts.withColumn("nodes", F.lit(n).cast("long")).withColumn("edges", F.lit(m).cast("long"))
        return counts.select("descr", F.round(expr(), 6).alias("value"))

    return run


MEASURES = {
    "sgd_density": (lambda: Q.density(F.col("k"), F.col("n")), False, "CASE WHEN n <= 1 THEN 0 ELSE k::DOUBLE / (n::DOUBLE * (n - 1)) END"),
    "sgd_average_degree": (lambda: Q.average_degree(F.col("k"), F.col("n")), False, "2 * k::DOUBLE / n"),
    "sgd_inverse_conductance": (lambda: Q.inverse_conductance(F.col("k"), F.col("n"), F.col("out"), F.col("in_")), False, "CASE WHEN o + i - 2 * k = 0 THEN 'inf'::DOUBLE ELSE k::DOUBLE / (o + i - 2 * k) END"),
    "sgd_simon": (lambda: Q.simon_measure(F.col("k"), F.col("n")), False, "CASE WHEN k = 0 THEN '-inf'::DOUBLE ELSE 3 * k::DOUBLE - n::DOUBLE * (n - 1) END"),
    "sgd_segregation": (lambda: Q.segregation_index(F.col("k"), F.col("n"), F.col("out"), F.col("in_"), F.col("nodes"), F.col("edges")), True, "1 - (o + i - 2 * k)::DOUBLE * nn * (nn - 1) / (m::DOUBLE * n * (nn - n))"),
    "sgd_edge_surplus": (lambda: Q.edge_surplus(F.col("k"), F.col("n")), False, "k::DOUBLE - (1::DOUBLE / 3) * n * (n - 1) / 2"),
    "sgd_modularity": (lambda: Q.local_modularity(F.col("w_in"), F.col("w_out"), F.col("w_into"), F.col("edges"), F.col("n")), True, "CASE WHEN n <= 1 THEN '-inf'::DOUBLE ELSE (k::DOUBLE - o::DOUBLE * i::DOUBLE / m) / m END"),
}


def sgd_iaodf(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = X.parts(spark, sf), X.copurchase(spark, sf)
    sel = part_selectors(nodes)
    return G.average_odf(edges, cover(nodes, "node_id", sel)).join(F.broadcast(selector_table(spark, sel)), "sg").select("descr", F.round("iaodf", 6).alias("value"))


def sgd_si_level1(spark: SparkSession, sf: str) -> DataFrame:
    """Which part attributes induce the most surprising co-purchase density?"""
    nodes, edges, counts, _ = _counts(spark, sf)
    n, m = G.totals(nodes, edges, once=True)
    counts = counts.withColumn("length", F.lit(1))
    return counts.select("descr", "n", "k", F.round(search.si_uniform(counts, n, m), 6).alias("si"))


def sgd_si_beam(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = X.parts(spark, sf), X.copurchase_once(spark, sf)
    with G.held(edges):
        n, m = G.totals(nodes, edges, once=True)
        return search.beam_graph(nodes, edges, search.Task(part_selectors(nodes), size=20, depth=2), search.si_uniform, n, m, once=True)


BEAM_SQL = f"""
WITH {GRAPH}, l1 AS (SELECT descr, n, k, {_SI1} AS q FROM stats, tot), seeds AS (SELECT * FROM l1 WHERE q > 0 ORDER BY q DESC, descr LIMIT 20),
pc AS (
  SELECT DISTINCT a.node, least(a.descr, b.descr) || ' AND ' || greatest(a.descr, b.descr) AS descr
  FROM covers a JOIN covers b ON a.node = b.node AND a.descr <> b.descr WHERE a.descr IN (SELECT descr FROM seeds)
), s2 AS (
  SELECT c.descr, c.n, coalesce(x.k, 0) AS k FROM (SELECT descr, count(*) AS n FROM pc GROUP BY 1) c
  LEFT JOIN (SELECT s.descr, count(*) AS k FROM edges e JOIN pc s ON s.node = e.src JOIN pc d ON d.node = e.dst AND d.descr = s.descr GROUP BY 1) x USING (descr)
), l2 AS (SELECT descr, n, k, round({_ic('k', 'n * (n - 1)', f'n * (n - 1) * {_P}')} / (0.3::DOUBLE * 2 + 0.5::DOUBLE), 6) AS q FROM s2, tot),
best AS (SELECT * FROM (SELECT * FROM seeds UNION ALL SELECT * FROM l2 WHERE q > 0) ORDER BY q DESC, descr LIMIT 20)
SELECT row_number() OVER (ORDER BY q DESC, descr)::INT AS rank, q AS quality, descr, n::BIGINT AS n, k::BIGINT AS k FROM best
"""


#: Attributes of the first sweep; each further one has twice as many, as long as there are that many.
SWEEP_FROM, SWEEP_SIZE = 5, 5


def attribute_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """The best subgroups of parts by who supplies them and who doesn't, for ever more suppliers as attributes."""
    nodes, edges = X.parts(spark, sf), X.copurchase_once(spark, sf)
    suppliers, sizes = X.table(spark, sf, "supplier").count(), []
    while (count := SWEEP_FROM << len(sizes)) <= suppliers:
        sizes.append(count)
    some = X.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("node_id"), F.col("l_suppkey").cast("int").alias("s")).filter(F.col("s").between(0, max(sizes, default=0) - 1))
    owned = nodes.select("node_id").join(some.groupBy("node_id").agg(F.collect_set("s").alias("by")), "node_id", "left").select(F.col("node_id").alias("node"), F.coalesce("by", F.array().cast("array<int>")).alias("by"))
    with G.held(edges):
        n, m = G.totals(nodes, edges)
        return search.beam_owners(owned, edges, sizes, search.Task([], size=SWEEP_SIZE, depth=2), search.si_uniform, n, 2 * m)


SWEEP_SQL = f"""
WITH {GRAPH}, sizes AS (SELECT a FROM (SELECT 5 * (1 << i) AS a FROM range(20) t(i)) WHERE a <= (SELECT count(*) FROM supplier)),
has AS (
  SELECT p_partkey AS node, s_suppkey AS s, (l_suppkey IS NOT NULL)::INT AS v FROM part CROSS JOIN supplier LEFT JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ON l_partkey = p_partkey AND l_suppkey = s_suppkey
  WHERE s_suppkey < (SELECT max(a) FROM sizes)
), own AS (SELECT node, (2 * s + v)::INT AS x, s, 's' || s || '=' || v AS descr FROM has),
k1 AS (SELECT a.x, count(*) AS k FROM edges JOIN own a ON a.node = src JOIN own b ON b.node = dst AND b.x = a.x GROUP BY 1),
l1 AS (SELECT x, s, any_value(descr) AS descr, count(*) AS n, any_value(coalesce(k, 0)) AS k FROM own LEFT JOIN k1 USING (x) GROUP BY x, s),
q1 AS (SELECT a, x, descr, n, k, {_SI1} AS q FROM l1 JOIN sizes ON s < a, tot),
seeds AS (SELECT * FROM q1 WHERE q > 0 QUALIFY row_number() OVER (PARTITION BY a ORDER BY q DESC, descr) <= {SWEEP_SIZE}),
firsts AS (SELECT DISTINCT x FROM seeds),
held AS (SELECT node, o.x, t.x AS y FROM own o JOIN firsts USING (x) JOIN own t USING (node) WHERE o.x <> t.x),
n2 AS (SELECT x, y, count(*) AS n FROM held GROUP BY ALL),
inner_ AS (SELECT src, dst, a.x FROM edges JOIN own a ON a.node = src JOIN firsts USING (x) JOIN own b ON b.node = dst AND b.x = a.x),
k2 AS (SELECT i.x, a.x AS y, count(*) AS k FROM inner_ i JOIN own a ON a.node = src JOIN own b ON b.node = dst AND b.x = a.x GROUP BY ALL),
pairs AS (
  SELECT DISTINCT a, least(e.descr, y.descr) || ' AND ' || greatest(e.descr, y.descr) AS descr, n2.n, coalesce(k2.k, 0) AS k
  FROM seeds e JOIN n2 USING (x) JOIN l1 y ON y.x = n2.y AND y.s < a LEFT JOIN k2 ON k2.x = n2.x AND k2.y = n2.y
), q2 AS (SELECT a, descr, n, k, CASE WHEN n = 1 THEN 0 ELSE round({_ic('k', 'n * (n - 1)', f'n * (n - 1) * {_P}')} / (0.3::DOUBLE * 2 + 0.5::DOUBLE), 6) END AS q FROM pairs, tot),
both_ AS (SELECT a, descr, n, k, q FROM seeds UNION ALL SELECT a, descr, n, k, q FROM q2 WHERE q > 0),
best AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY q DESC, descr) AS rank FROM both_)
SELECT a::INT AS attributes, rank::INT AS rank, q AS quality, descr, n::BIGINT AS n, k::BIGINT AS k FROM best WHERE rank <= {SWEEP_SIZE}
"""


def _pairs(spark: SparkSession, sf: str, constrained: bool) -> DataFrame:
    nodes, edges = X.parts(spark, sf), X.copurchase(spark, sf)
    sel = part_selectors(nodes)
    n, m = G.totals(nodes, edges)
    groups = cover(nodes, "node_id", sel)
    t = selector_table(spark, sel)
    grid = G.pair_counts(edges, groups, groups).join(F.broadcast(t.select(F.col("sg").alias("a"), F.col("descr"), F.col("attribute").alias("a1"))), "a")
    grid = grid.join(F.broadcast(t.select(F.col("sg").alias("b"), F.col("descr").alias("descr2"), F.col("attribute").alias("a2"))), "b").filter("a != b")
    grid = grid.filter("a1 = a2") if constrained else grid
    p = m / (n * (n - 1))
    return grid.select("descr", "descr2", "k", "n", F.round(Q.subjective_interestingness(F.col("k"), F.col("n"), F.col("n") * F.lit(p), 2), 6).alias("si"))


def _pairs_sql(constrained: bool) -> str:
    return f"""
WITH {GRAPH}, sizes AS (SELECT descr, attr, count(*) AS n FROM covers GROUP BY ALL),
kk AS (SELECT s.descr AS a, d.descr AS b, count(*) AS k FROM edges e JOIN covers s ON s.node = e.src JOIN covers d ON d.node = e.dst GROUP BY ALL),
cc AS (SELECT s.descr AS a, d.descr AS b, count(*) AS c FROM covers s JOIN covers d ON s.node = d.node GROUP BY ALL),
g AS (
  SELECT x.descr, y.descr AS descr2, coalesce(kk.k, 0)::BIGINT AS k, (x.n * y.n - coalesce(cc.c, 0))::BIGINT AS n FROM sizes x JOIN sizes y ON x.descr <> y.descr {'AND x.attr = y.attr' if constrained else ''}
  LEFT JOIN kk ON kk.a = x.descr AND kk.b = y.descr LEFT JOIN cc ON cc.a = x.descr AND cc.b = y.descr
)
SELECT descr, descr2, k, n, round({_ic('k', 'n', f'n * {_P}')} / (0.3::DOUBLE * 2 + 0.5::DOUBLE), 6) AS si FROM g, tot
"""


def bi_beam(spark: SparkSession, sf: str, constrained: bool = False) -> DataFrame:
    nodes, edges = X.parts(spark, sf), X.copurchase_once(spark, sf)
    with G.held(edges):
        n, m = G.totals(nodes, edges, once=True)
        return search.beam_pairs(nodes, edges, search.Task(part_selectors(nodes), size=6, depth=2), n, m, constrained=constrained, once=True)


def bi_beam_constrained(spark: SparkSession, sf: str) -> DataFrame:
    return bi_beam(spark, sf, constrained=True)


# ---- degrees, density, priors ----------------------------------------------------------------------------------------------


def graph_density(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = X.parts(spark, sf), X.copurchase_once(spark, sf)
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg((2 * F.count("*")).alias("edges"))).withColumn("density", F.try_divide(F.col("edges").cast("double"), (F.col("nodes") * (F.col("nodes") - 1)).cast("double")))


def graph_margins(spark: SparkSession, sf: str) -> DataFrame:
    return G.margins(X.users(spark, sf), X.successions(spark, sf))


_SUCC = """steps AS (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) AS dst FROM events),
succ AS (SELECT src, dst, count(*)::DOUBLE AS weight FROM steps WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL), us AS (SELECT DISTINCT user_id AS node FROM events),
marg AS (SELECT node, coalesce(o, 0)::BIGINT AS out_degree, coalesce(i, 0)::BIGINT AS in_degree FROM us LEFT JOIN (SELECT src AS node, count(*) AS o FROM succ GROUP BY 1) USING (node) LEFT JOIN (SELECT dst AS node, count(*) AS i FROM succ GROUP BY 1) USING (node))"""


def graph_degree_hist(spark: SparkSession, sf: str) -> DataFrame:
    return graph_margins(spark, sf).groupBy("out_degree", "in_degree").agg(F.count("*").alias("n"))


def prior_uniform(spark: SparkSession, sf: str) -> DataFrame:
    d = graph_density(spark, sf)
    return d.select(F.round(F.log(F.col("density") / (1 - F.col("density"))), 9).alias("logit"))


def _residual_frame(spark: SparkSession, rows: list, a: np.ndarray, b: np.ndarray, square: bool = True) -> DataFrame:
    return spark.createDataFrame([(o, i, n, round(eo, 4) + 0.0, round(ei, 4) + 0.0) for o, i, n, eo, ei in prior.residuals(rows, a, b, square)], "out_degree long, in_degree long, n long, expected_out double, expected_in double")


def _fit(rows: list, square: bool = True) -> tuple[np.ndarray, np.ndarray]:
    return prior.fit_degrees(*(np.array([r[c] for r in rows]) for c in ("out_degree", "in_degree", "n")), square=square)


def prior_degree(spark: SparkSession, sf: str) -> DataFrame:
    """Expected margins of the fitted degree prior of the undirected graph."""
    _, rows = prior.degree_classes(G.margins(X.parts(spark, sf), X.copurchase_once(spark, sf), once=True))
    return _residual_frame(spark, rows, *_fit(rows))


def prior_degree_directed(spark: SparkSession, sf: str) -> DataFrame:
    _, rows = prior.degree_classes(graph_margins(spark, sf))
    return _residual_frame(spark, rows, *_fit(rows))


def prior_rectangular(spark: SparkSession, sf: str) -> DataFrame:
    """Expected row margins of customers by suppliers."""
    cells = X.customer_supplier(spark, sf)
    r, c = (cells.groupBy(k).count().groupBy(F.col("count").alias("degree")).agg(F.count("*").alias("n")).orderBy("degree").limit(prior.MOST_CLASSES + 1).collect() for k in ("row_id", "col_id"))
    if max(len(r), len(c)) > prior.MOST_CLASSES:
        raise ValueError(f"more than {prior.MOST_CLASSES} classes of nodes")
    # Rows are classes that only send, columns classes that only receive.
    out = np.array([x["degree"] for x in r] + [0] * len(c), float)
    in_ = np.array([0] * len(r) + [x["degree"] for x in c], float)
    n = np.array([x["n"] for x in r] + [x["n"] for x in c], float)
    a, b = prior.fit_degrees(out, in_, n, square=False)
    k = len(r)
    p = prior.sigmoid(a[:k, None] + b[None, k:])
    got = (p * n[None, k:]).sum(1)
    return spark.createDataFrame([(int(x["degree"]), int(x["n"]), round(float(g), 4)) for x, g in zip(r, got, strict=True)], "degree long, n long, expected double")


def prior_block(spark: SparkSession, sf: str) -> DataFrame:
    """Expected and actual edges between part types under the prior of degrees and type pairs."""
    nodes, edges = X.parts(spark, sf), _cut(X.copurchase_once(spark, sf))
    labelled = G.margins(nodes, edges, once=True).join(nodes.select(F.col("node_id").alias("node"), "p_type"), "node")
    _, rows = prior.degree_classes(labelled, ["p_type"])
    names = sorted({r["p_type"] for r in rows})
    label = np.array([names.index(r["p_type"]) for r in rows])
    kind = nodes.select("node_id", F.col("p_type"))
    got = edges.join(kind.toDF("src", "a"), "src").join(kind.toDF("dst", "b"), "dst").groupBy("a", "b").count().collect()
    want = np.zeros((len(names), len(names)))
    for r in got:
        want[names.index(r["a"]), names.index(r["b"])] = r["count"]
    want = want + want.T
    a, b, g = prior.fit_blocks(rows, label, want)
    n = np.array([r["n"] for r in rows], float)
    e = prior.sigmoid(a[:, None] + b[None, :] + g[label][:, label]) * n[:, None] * (n[None, :] - np.eye(len(n)))
    one = np.eye(len(names))[label]
    e = one.T @ e @ one
    return spark.createDataFrame([(x, y, round(float(e[i, j]), 1)) for i, x in enumerate(names) for j, y in enumerate(names)], "a string, b string, expected double")


def pattern_update(spark: SparkSession, sf: str) -> DataFrame:
    """After the update, the model expects the edges that the most surprising pattern has: iterated mining with a degree prior."""
    nodes, edges = X.parts(spark, sf), _cut(X.copurchase_once(spark, sf))
    degrees, rows = prior.degree_classes(_cut(G.margins(nodes, edges, once=True)))
    a, b = _fit(rows)
    sel = part_selectors(nodes)
    at = {(r["out_degree"], r["in_degree"]): i for i, r in enumerate(rows)}
    logit = a[:, None] + b[None, :]
    groups, between = G.by_cover(edges, cover(nodes, "node_id", sel), once=True, every=True, parts=X.pair_tasks(spark, sf))
    counts = G.group_counts(between, groups).collect()
    hist: dict[int, np.ndarray] = {r["sg"]: np.zeros(len(rows)) for r in counts}
    for r in cover(nodes, "node_id", sel).join(degrees, "node").select("out_degree", "in_degree", F.explode("ids").alias("sg")).groupBy("sg", "out_degree", "in_degree").count().collect():
        hist[r["sg"]][at[r["out_degree"], r["in_degree"]]] = r["count"]
    out = []
    for r in counts:
        h = hist[r["sg"]]
        pairs = np.outer(h, h) - np.diag(h)
        lam = prior.pattern_lambda(logit, pairs, r["k"])
        out.append((sel[r["sg"]].descr, r["k"], round(float((pairs * prior.sigmoid(logit + lam)).sum()), 3)))
    return spark.createDataFrame(out, "descr string, k long, expected double")


# ---- selectors and supports ------------------------------------------------------------------------------------------------


def selectors_nominal(spark: SparkSession, sf: str) -> DataFrame:
    nodes = X.parts(spark, sf)
    sel = part_selectors(nodes)
    return cover(nodes, "node_id", sel).select(F.explode("ids").alias("sg")).groupBy("sg").agg(F.count("*").alias("n")).join(F.broadcast(selector_table(spark, sel)), "sg").select("descr", "n")


def selectors_numeric(spark: SparkSession, sf: str) -> DataFrame:
    nodes = X.parts(spark, sf)
    return spark.createDataFrame([(c, i, float(v)) for c in ("p_size", "p_retailprice") for i, v in enumerate(equal_frequency_cuts(nodes, c))], "attribute string, cut long, value double")


_CUTS_SQL = "SELECT '{c}' AS attribute, (i - 1)::BIGINT AS cut, v::DOUBLE AS value FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS r, count(*) OVER () AS n FROM part), (SELECT unnest([1, 2, 3, 4]) AS i) WHERE r = i * n // 5"


def quartile_store(spark: SparkSession, sf: str) -> DataFrame:
    nodes = X.parts(spark, sf)
    cuts = {c: frequency_cuts(nodes, c) for c in ("p_size", "p_retailprice")}
    return prep.quartile_support(nodes, "node_id", cuts).groupBy("cut").agg(F.count("*").alias("n"))


def vote_store(spark: SparkSession, sf: str) -> DataFrame:
    votes = X.table(spark, sf, "customer").select("c_custkey", F.signum("c_acctbal").cast("int").alias("v0"), F.signum(F.col("c_acctbal") - 4500).cast("int").alias("v1"))
    return prep.votes_support(votes, "c_custkey", ["v0", "v1"]).groupBy("cut").agg(F.count("*").alias("n"))


# ---- classic subgroup discovery --------------------------------------------------------------------------------------------


def line_data(spark: SparkSession, sf: str) -> tuple[DataFrame, list[Selector]]:
    data = X.table(spark, sf, "lineitem")
    sel: list[Selector] = [*nominal_selectors(data, "l_linestatus"), *[Nominal("l_linenumber", i) for i in range(1, 8)]]
    sel += [Interval("l_quantity", a, a + 10.0) for a in (1.0, 11.0, 21.0, 31.0, 41.0)] + [Interval("l_discount", -float("inf"), 0.03), Interval("l_discount", 0.03, 0.07), Interval("l_discount", 0.07, float("inf"))]
    return data, sel


_ROWS = """rowsx AS (
  SELECT row_number() OVER () AS rid, (l_returnflag = 'R')::INT::DOUBLE AS t, l_extendedprice AS x, l_quantity AS w, list_filter([
    'l_linestatus=' || l_linestatus, 'l_linenumber=' || l_linenumber,
    CASE WHEN l_quantity >= 1 AND l_quantity < 51 THEN 'l_quantity: [' || (floor((l_quantity - 1) / 10) * 10 + 1)::INT || ':' || (floor((l_quantity - 1) / 10) * 10 + 11)::INT || ']' END,
    CASE WHEN l_discount < 0.03::DOUBLE THEN 'l_discount<0.03' WHEN l_discount < 0.07::DOUBLE THEN 'l_discount: [0.03:0.07]' ELSE 'l_discount>=0.07' END], lambda s: s IS NOT NULL) AS ids FROM lineitem
), tot AS (SELECT count(*)::DOUBLE AS nn, sum(t) AS pos, avg(x) AS mean, sum(w) AS ww, sum(t * w) AS wpos FROM rowsx),
lv AS (SELECT descr, count(*)::DOUBLE AS n_sg, sum(t) AS pos_sg, avg(x) AS mean_sg, sum(w) AS w_sg, sum(t * w) AS wpos_sg FROM (SELECT unnest(ids) AS descr, t, x, w FROM rowsx) GROUP BY 1)"""


def _nominal_counts(spark: SparkSession, sf: str, weight: str | None = None) -> DataFrame:
    data, sel = line_data(spark, sf)
    c = search.Candidates(sel, [(i,) for i in range(len(sel))])
    target = (F.col("l_returnflag") == "R").cast("double")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    n, pos = data.select(F.sum(w), F.sum(target * w)).first()
    counts = search.target_counts(data, "l_orderkey", c, target, weight=F.col(weight) if weight else None).join(F.broadcast(c.table(spark)), "sg")
    return counts.withColumns({"n": F.lit(float(n)), "pos": F.lit(float(pos))})


def _stats(counts: DataFrame) -> DataFrame:
    n, pos, a, b = (F.col(c) for c in ("n", "pos", "n_sg", "pos_sg"))
    return counts.select(
        "descr", F.round(a, 6).alias("size_sg"), F.round(b, 6).alias("positives_sg"), F.round(n - a, 6).alias("size_complement"), F.round(a / n, 9).alias("relative_size_sg"),
        F.round(b / pos, 9).alias("coverage_sg"), F.round((pos - b) / pos, 9).alias("coverage_complement"), F.round(b / a, 9).alias("target_share_sg"), F.round(F.try_divide(pos - b, n - a), 9).alias("target_share_complement"),
        F.round(pos / n, 9).alias("target_share_dataset"), F.round((b / a) / (pos / n), 9).alias("lift"),
    )


def _stats_sql(n: str, pos: str, a: str, b: str) -> str:
    return f"""WITH {_ROWS} SELECT descr, round({a}, 6) AS size_sg, round({b}, 6) AS positives_sg, round({n} - {a}, 6) AS size_complement, round({a} / {n}, 9) AS relative_size_sg, round({b} / {pos}, 9) AS coverage_sg,
round(({pos} - {b}) / {pos}, 9) AS coverage_complement, round({b} / {a}, 9) AS target_share_sg, round(({pos} - {b}) / nullif({n} - {a}, 0), 9) AS target_share_complement, round({pos} / {n}, 9) AS target_share_dataset, round(({b} / {a}) / ({pos} / {n}), 9) AS lift FROM lv, tot"""


def sd_stats_numeric(spark: SparkSession, sf: str) -> DataFrame:
    data, sel = line_data(spark, sf)
    hits = F.explode(F.array_compact(F.array(*[F.when(s.covers(), F.lit(s.descr)) for s in sel])))
    x = F.col("l_extendedprice")
    mean = data.agg(F.avg(x)).first()[0]
    whole = post.exact_medians(data.select(F.lit("").alias("descr"), x.alias("x")), "descr", "x").first()
    median = whole["median"] if whole else None
    long = data.select(hits.alias("descr"), x.alias("x"))
    s = long.groupBy("descr").agg(F.count("*").alias("size_sg"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.max("x").alias("max"), F.min("x").alias("min"))
    s = s.join(post.exact_medians(long, "descr", "x"), "descr", "left")
    return s.select("descr", "size_sg", *[F.round(c, 4).alias(f"{c}_sg") for c in ("mean", "std", "median", "max", "min")], F.round(F.col("mean") / mean, 6).alias("mean_lift"), F.round(F.col("median") / median, 6).alias("median_lift"))


def _sd(expr: Callable[[], object]) -> Callable:
    return lambda spark, sf: _nominal_counts(spark, sf).select("descr", F.round(expr(), 6).alias("quality"))


_ARGS = lambda: (F.col("n"), F.col("pos"), F.col("n_sg"), F.col("pos_sg"))
_CHI = "(nn * power(abs(pos_sg * (nn - n_sg - pos + pos_sg) - (pos - pos_sg) * (n_sg - pos_sg)), 2) / (pos * (nn - pos) * n_sg * (nn - n_sg)))"
SD = {
    "sd_wracc": (lambda: Q.standard(1.0, *_ARGS()), "(n_sg / nn) * (pos_sg / n_sg - pos / nn)"),
    "sd_lift": (lambda: Q.standard(0.0, *_ARGS()), "pos_sg / n_sg - pos / nn"),
    "sd_binomial": (lambda: Q.standard(0.5, *_ARGS()), "power(n_sg / nn, 0.5) * (pos_sg / n_sg - pos / nn)"),
    "sd_chi_squared": (lambda: Q.chi_squared(*_ARGS()), f"CASE WHEN n_sg < 5 OR nn - n_sg < 5 THEN '-inf'::DOUBLE ELSE {_CHI} END"),
    "sd_chi_squared_positive": (lambda: Q.chi_squared(*_ARGS(), direction="positive"), f"CASE WHEN n_sg < 5 OR nn - n_sg < 5 THEN '-inf'::DOUBLE WHEN pos_sg / n_sg > pos / nn THEN {_CHI} ELSE -{_CHI} END"),
    "sd_bound": (lambda: Q.standard_bound(1.0, *_ARGS()), "CASE WHEN pos_sg = 0 THEN 0 ELSE (pos_sg / nn) * (1 - pos / nn) END"),
    "sd_count": (lambda: F.col("n_sg"), "n_sg"),
    "sd_area": (lambda: F.col("length") * F.col("n_sg"), "n_sg"),
    "sd_combined": (lambda: Q.combined([Q.standard(1.0, *_ARGS()), Q.standard(0.0, *_ARGS())], [2.0, 0.5]), "2 * ((n_sg / nn) * (pos_sg / n_sg - pos / nn)) + 0.5 * (pos_sg / n_sg - pos / nn)"),
}


def sd_standard_numeric(spark: SparkSession, sf: str) -> DataFrame:
    data, sel = line_data(spark, sf)
    c = search.Candidates(sel, [(i,) for i in range(len(sel))])
    mean = data.agg(F.avg("l_extendedprice")).first()[0]
    counts = search.target_counts(data, "l_orderkey", c, F.col("l_extendedprice"), numeric=True).join(F.broadcast(c.table(spark)), "sg")
    return counts.select("descr", F.round(Q.standard_numeric(0.5, F.lit(mean), F.col("n_sg"), F.col("mean_sg")), 3).alias("quality"))


def sd_dfs_numeric_bound(spark: SparkSession, sf: str) -> DataFrame:
    """For each selector the best quality that a prefix of its rows, by falling target, reaches: sizes and sums of distinct values run on."""
    from pyspark.sql import Window as W

    data, sel = line_data(spark, sf)
    mean = data.agg(F.avg("l_quantity")).first()[0]
    hits = F.explode(F.array_compact(F.array(*[F.when(s.covers(), F.lit(s.descr)) for s in sel if s.attribute != "l_quantity"])))
    values = data.select(hits.alias("descr"), F.col("l_quantity").alias("t")).groupBy("descr", "t").agg(F.count("*").alias("c"))
    w = W.partitionBy("descr").orderBy(F.desc("t")).rowsBetween(W.unboundedPreceding, 0)
    run = values.withColumns({"size": F.sum("c").over(w), "total": F.sum(F.col("t") * F.col("c")).over(w)})
    return run.groupBy("descr").agg(F.round(F.max(F.col("size") * (F.col("total") / F.col("size") - mean)), 3).alias("bound"))


def _generalisation(spark: SparkSession, sf: str) -> DataFrame:
    data, sel = line_data(spark, sf)
    n_sel = len(sel)
    pairs = [(i, j) for i in range(n_sel) for j in range(i + 1, n_sel) if sel[i].attribute != sel[j].attribute]
    c = search.Candidates(sel, [(i,) for i in range(n_sel)] + pairs)
    target = (F.col("l_returnflag") == "R").cast("double")
    n, pos = data.select(F.count("*"), F.sum(target)).first()
    counts = search.target_counts(data, "l_orderkey", c, target).join(F.broadcast(c.table(spark)), "sg").withColumn("share", F.col("pos_sg") / F.col("n_sg"))
    parts = spark.createDataFrame([(i, c.sets.index((x,))) for i, s in enumerate(c.sets) if len(s) == 2 for x in s], "sg int, part int")
    best = parts.join(counts.select(F.col("sg").alias("part"), "share"), "part").groupBy("sg").agg(F.max("share").alias("best"))
    top = F.greatest(F.coalesce("best", F.lit(0.0)), F.lit(float(pos) / n))
    return counts.join(best, "sg", "left").select("descr", F.round(F.sqrt(F.col("n_sg") / float(n)) * (F.col("share") - top), 6).alias("quality"))


GA_SQL = f"""WITH {_ROWS}, pairs AS (
  SELECT least(a, b) AS a, greatest(a, b) AS b, t FROM (SELECT rid, t, unnest(ids) AS a, ids FROM rowsx), (SELECT 1) JOIN (SELECT rid, unnest(ids) AS b FROM rowsx) USING (rid) WHERE a < b
), p AS (SELECT a, b, count(*)::DOUBLE AS n_sg, sum(t) AS pos_sg FROM pairs GROUP BY ALL)
SELECT descr, round(sqrt(n_sg / nn) * (pos_sg / n_sg - pos / nn), 6) AS quality FROM lv, tot
UNION ALL SELECT p.a || ' AND ' || p.b, round(sqrt(p.n_sg / nn) * (p.pos_sg / p.n_sg - greatest(x.pos_sg / x.n_sg, y.pos_sg / y.n_sg, pos / nn)), 6) FROM p JOIN lv x ON x.descr = a JOIN lv y ON y.descr = b, tot"""


def _search(kind: Callable) -> Callable:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        data, sel = line_data(spark, sf)
        return kind(data, "l_orderkey", search.Task(sel, size=15, depth=2), (F.col("l_returnflag") == "R").cast("double"))

    return run


TOPK_SQL = f"""WITH {_ROWS}, pairs AS (
  SELECT least(a, b) AS a, greatest(a, b) AS b, t FROM (SELECT rid, t, unnest(ids) AS a FROM rowsx) JOIN (SELECT rid, unnest(ids) AS b FROM rowsx) USING (rid) WHERE a < b
), alls AS (SELECT descr, n_sg, pos_sg FROM lv UNION ALL SELECT a || ' AND ' || b, count(*)::DOUBLE, sum(t) FROM pairs GROUP BY a, b),
q AS (SELECT descr, n_sg, pos_sg, round((n_sg / nn) * (pos_sg / n_sg - pos / nn), 9) AS quality FROM alls, tot)
SELECT row_number() OVER (ORDER BY quality DESC, descr)::INT AS rank, quality, descr, n_sg::BIGINT AS n, pos_sg::BIGINT AS pos FROM (SELECT * FROM q WHERE quality > 0 ORDER BY quality DESC, descr LIMIT 15)"""

# ---- results ---------------------------------------------------------------------------------------------------------------


def post_minimum_quality(spark: SparkSession, sf: str) -> DataFrame:
    return post.minimum_quality(SDQ["sd_wracc"](spark, sf), 0.0)


def post_unique_attributes(spark: SparkSession, sf: str) -> DataFrame:
    r = SDQ["sd_wracc"](spark, sf).withColumn("attributes", F.array(F.regexp_extract("descr", r"^(\w+)", 1)))
    return post.unique_attributes(r.withColumn("all_categorical", F.element_at("attributes", 1) == "l_linestatus")).select("descr", "quality")


def post_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    data, sel = line_data(spark, sf)
    groups = data.select(F.lit(0).alias("node"), F.array_compact(F.array(*[F.when(s.covers(), F.lit(i)) for i, s in enumerate(sel)])).alias("ids"))
    t = F.broadcast(selector_table(spark, sel))
    pairs = post.jaccard(groups).join(t.select(F.col("sg").alias("a"), F.col("descr").alias("x")), "a").join(t.select(F.col("sg").alias("b"), F.col("descr").alias("y")), "b")
    return pairs.select(F.least("x", "y").alias("descr"), F.greatest("x", "y").alias("descr2"), F.round("jaccard", 9).alias("jaccard"))


def post_roc(spark: SparkSession, sf: str) -> DataFrame:
    return post.rounded(post.roc_points(_nominal_counts(spark, sf)), {"fpr": 9, "tpr": 9})


def enrichment_fisher(spark: SparkSession, sf: str) -> DataFrame:
    """Is a brand's share among the large parts unusual?  Two-sided exact tests."""
    big = X.parts(spark, sf).select("p_brand", (F.col("p_size") > 40).cast("long").alias("big"))
    n, s = big.select(F.count("*"), F.sum("big")).first()
    t = big.groupBy("p_brand").agg(F.sum("big").alias("a"), F.count("*").alias("r")).select("p_brand", "a", (F.col("r") - F.col("a")).alias("b"), (F.lit(s) - F.col("a")).alias("c"), (F.lit(n - s) - F.col("r") + F.col("a")).alias("d"))
    return post.fisher_two_sided(t).select("p_brand", F.round("p", 6).alias("p"))


FISHER_SQL = """WITH big AS (SELECT p_brand, (p_size > 40)::INT AS g FROM part), tt AS (SELECT count(*) AS n, sum(g) AS s FROM big),
t AS (SELECT p_brand, sum(g)::BIGINT AS a, count(*)::BIGINT AS r FROM big GROUP BY 1), x AS (SELECT p_brand, a, r, n, s::BIGINT AS s, unnest(range(greatest(0, r + s::BIGINT - n), least(r, s::BIGINT) + 1)) AS k FROM t, tt),
p AS (SELECT *, exp(lgamma(r + 1) + lgamma(n - r + 1) + lgamma(s + 1) + lgamma(n - s + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(r - k + 1) - lgamma(s - k + 1) - lgamma(n - r - s + k + 1)) AS pr FROM x),
o AS (SELECT p_brand, pr AS po FROM p WHERE k = a) SELECT p_brand, round(least(sum(pr) FILTER (WHERE pr <= po * (1 + 1e-7)), 1), 6) AS p FROM p JOIN o USING (p_brand) GROUP BY 1"""

# ---- summaries -------------------------------------------------------------------------------------------------------------


def _brand_support(nodes: DataFrame) -> tuple[DataFrame, list[Selector]]:
    sel = nominal_selectors(nodes, "p_brand")
    return cover(nodes, "node_id", sel).select(F.explode("ids").alias("cut"), "node"), sel


def summary_split_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the first split by every brand."""
    nodes, edges = X.parts(spark, sf), _cut(X.copurchase_once(spark, sf))
    n, m = G.totals(nodes, edges, once=True)
    sel = nominal_selectors(nodes, "p_brand")
    groups, between = G.by_cover(edges, cover(nodes, "node_id", sel), once=True, every=True, parts=X.pair_tasks(spark, sf))
    c = G.group_counts(between, groups).join(F.broadcast(selector_table(spark, sel)), "sg")
    p, k, a = F.lit(m / (n * (n - 1))), F.col("k"), F.col("n")
    o = F.lit(n).cast("long") - a
    part = lambda kk, nn: Q.information_content(kk, nn, nn * p)
    total = part(k, a * (a - 1)) + part(F.col("out") - k, a * o) + part(F.col("in_") - k, a * o) + part(F.lit(m).cast("long") - F.col("out") - F.col("in_") + k, o * (o - 1))
    return c.select("descr", F.round(total / 55, 6).alias("si"))


_D = "(nn - n)"
SPLIT_SQL = f"WITH {GRAPH} SELECT descr, round(({_ic('k', 'n * (n - 1)', f'n * (n - 1) * {_P}')} + {_ic('o - k', f'n * {_D}', f'n * {_D} * {_P}')} + {_ic('i - k', f'n * {_D}', f'n * {_D} * {_P}')} + {_ic('m - o - i + k', f'{_D} * ({_D} - 1)', f'{_D} * ({_D} - 1) * {_P}')}) / 55, 6) AS si FROM stats, tot WHERE attr = 'p_brand'"


def summary_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The three splits of a summary: what is cut off, from which block, and how surprising the blocks are then."""
    nodes, edges = X.parts(spark, sf), X.copurchase_once(spark, sf)
    support, sel = _brand_support(nodes)
    with G.held(edges, support):
        n, m = G.totals(nodes, edges, once=True)
        done = summarize.summarize(nodes, edges, support, m / (n * (n - 1)), once=True)[1]
    return spark.createDataFrame([(i, sel[cut].descr, block, si) for i, si, cut, block in done], "round int, descr string, split_block int, si double")


def _summary_sql(rounds: int) -> str:
    """Every round labels all nodes once for each block and brand that could split it, scores all pairs of blocks, and takes the best."""
    parts = [GRAPH, "b0 AS (SELECT p_partkey AS node, p_brand AS brand, 0 AS block FROM part)"]
    for i in range(1, rounds + 1):
        parts += [
            f"sizes{i} AS MATERIALIZED (SELECT block, count(*) AS size FROM b{i - 1} GROUP BY 1)",
            f"cand{i} AS MATERIALIZED (SELECT block AS sb, brand AS cut FROM b{i - 1} JOIN sizes{i} USING (block) WHERE brand IS NOT NULL GROUP BY ALL HAVING count(*) < any_value(size))",
            f"lab{i} AS MATERIALIZED (SELECT sb, cut, node, CASE WHEN block = sb AND brand IS NOT DISTINCT FROM cut THEN -1 ELSE block END AS x FROM cand{i}, b{i - 1})",
            f"sz{i} AS MATERIALIZED (SELECT sb, cut, x, count(*) AS c FROM lab{i} GROUP BY ALL)",
            f"ke{i} AS MATERIALIZED (SELECT s.sb, s.cut, s.x, d.x AS y, count(*) AS k FROM edges JOIN lab{i} s ON s.node = src JOIN lab{i} d ON d.node = dst AND d.sb = s.sb AND d.cut = s.cut GROUP BY ALL)",
            f"cell{i} AS (SELECT a.sb, a.cut, coalesce(k, 0) AS k, CASE WHEN a.x = b.x THEN a.c * (a.c - 1) ELSE a.c * b.c END AS n FROM sz{i} a JOIN sz{i} b ON a.sb = b.sb AND a.cut = b.cut LEFT JOIN ke{i} e ON e.sb = a.sb AND e.cut = a.cut AND e.x = a.x AND e.y = b.x)",
            f"best{i} AS MATERIALIZED (SELECT sb, cut, round(sum({_ic('k', 'n', f'n * {_P}')}) / {(i + 1) * (i + 2) // 2 + i + 1 + 50}, 6) AS si FROM cell{i}, tot GROUP BY ALL ORDER BY si DESC, sb, cut LIMIT 1)",
            f"b{i} AS MATERIALIZED (SELECT node, brand, CASE WHEN block = sb AND brand IS DISTINCT FROM cut THEN {i} ELSE block END AS block FROM b{i - 1}, best{i})",
        ]
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT {i}::INT AS round, 'p_brand=' || cut AS descr, sb::INT AS split_block, si FROM best{i}" for i in range(1, rounds + 1))


def block_density(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = X.parts(spark, sf), X.copurchase(spark, sf)
    return summarize.block_counts(edges, nodes.select(F.col("node_id").alias("node"), F.col("p_type").alias("block"))).select("bi", "bj", "k", "n", F.round("density", 9).alias("density"))


BLOCK_SQL = f"""WITH {GRAPH}, s AS (SELECT p_type AS b, count(*) AS c FROM part GROUP BY 1), kk AS (SELECT x.p_type AS bi, y.p_type AS bj, count(*) AS k FROM edges JOIN part x ON x.p_partkey = src JOIN part y ON y.p_partkey = dst GROUP BY ALL),
g AS (SELECT s.b AS bi, t.b AS bj, coalesce(kk.k, 0)::BIGINT AS k, (CASE WHEN s.b = t.b THEN s.c * (s.c - 1) ELSE s.c * t.c END)::BIGINT AS n FROM s CROSS JOIN s t LEFT JOIN kk ON kk.bi = s.b AND kk.bj = t.b)
SELECT bi, bj, k, n, round(CASE WHEN n = 0 THEN 0 ELSE k::DOUBLE / n END, 9) AS density FROM g"""

# ---- preparation -----------------------------------------------------------------------------------------------------------


def _tags(spark: SparkSession, sf: str) -> DataFrame:
    return X.table(spark, sf, "events").select(F.col("user_id").alias("id"), F.concat_ws(":", "event_type", F.get_json_object("props", "$.k")).alias("tag"))


def tags_topk(spark: SparkSession, sf: str) -> DataFrame:
    return prep.top_tags(_tags(spark, sf), 20)


def multihot(spark: SparkSession, sf: str) -> DataFrame:
    t = _tags(spark, sf)
    return prep.multi_hot(t, prep.top_tags(t, 20))


_TAGS = "t AS (SELECT user_id AS id, event_type || ':' || json_extract_string(props, '$.k') AS tag FROM events), top AS (SELECT tag, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, tag LIMIT 20)"


def country_tokens(spark: SparkSession, sf: str) -> DataFrame:
    orgs = X.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("University of "), F.initcap("n_name"), F.lit(", USA")).alias("org"))
    return prep.countries_of(orgs)


def json_explode(spark: SparkSession, sf: str) -> DataFrame:
    e = X.table(spark, sf, "events").select("event_type", F.from_json("props", "map<string,double>").alias("m"))
    return e.select("event_type", F.explode("m").alias("key", "value")).groupBy("event_type", "key").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def coo_sum(spark: SparkSession, sf: str) -> DataFrame:
    lines = X.table(spark, sf, "lineitem").select((F.col("l_partkey") % 50).alias("row"), (F.col("l_suppkey") % 20).alias("col"), F.col("l_quantity").alias("value"))
    return coordinates(lines, 50, 20)


def subsample(spark: SparkSession, sf: str) -> DataFrame:
    return prep.subsample(X.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 8)


def topics_pca(spark: SparkSession, sf: str) -> DataFrame:
    t = prep.principal_axes(X.table(spark, sf, "embeddings"), "vec_id", "embedding", 5)
    return t.select("vec_id", F.transform("topics", lambda x: F.round(x, 6)).alias("topics"))


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    made, silhouette = prep.k_means(X.table(spark, sf, "embeddings"), "vec_id", "embedding", 8)
    return made.withColumn("silhouette", F.lit(round(silhouette, 6)))


def dbscan(spark: SparkSession, sf: str) -> DataFrame:
    pts = X.table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 40).alias("y"))
    return prep.dbscan_cores(pts, "p_partkey", ["x", "y"], 1.0, 3)


def mrd_rows(spark: SparkSession, sf: str) -> DataFrame:
    from lodevein.sources.readers import relations

    lines = X.table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus")
    made = relations(lines)
    out = None
    for name, r in made.items():
        part = r.select(F.lit(name).alias("relation"), "row_id", F.col("col_id").cast("string").alias("col_id"))
        out = part if out is None else out.union(part)
    return out.groupBy("relation", "col_id").agg(F.count("*").alias("n"))


def selectors_auto(spark: SparkSession, sf: str) -> DataFrame:
    nodes = X.parts(spark, sf)
    return spark.createDataFrame([(i, s.descr) for i, s in enumerate(create_selectors(nodes, ignore=("node_id",)))], "ord long, descr string")


_AUTO_SQL = f"""WITH cuts AS ({" UNION ALL ".join(f"SELECT {g} AS g, * FROM ({_CUTS_SQL.format(c=c)})" for g, c in ((2, "p_size"), (3, "p_retailprice")))}),
t AS (SELECT g, cut, attribute AS a, CASE WHEN value = floor(value) THEN value::BIGINT::VARCHAR ELSE round(value, 2)::VARCHAR END AS v FROM cuts),
s AS (SELECT 0 AS g, row_number() OVER (ORDER BY p_brand) AS o, 'p_brand=' || p_brand AS descr FROM (SELECT DISTINCT p_brand FROM part) UNION ALL SELECT 1, row_number() OVER (ORDER BY p_type), 'p_type=' || p_type FROM (SELECT DISTINCT p_type FROM part)
UNION ALL SELECT g, cut, CASE WHEN cut = 0 THEN a || '<' || v ELSE a || ': [' || lag(v) OVER (PARTITION BY g ORDER BY cut) || ':' || v || ']' END FROM t UNION ALL SELECT g, 4, a || '>=' || v FROM t WHERE cut = 3)
SELECT row_number() OVER (ORDER BY g, o) - 1 AS ord, descr FROM s"""


def numeric_one_sided(spark: SparkSession, sf: str) -> DataFrame:
    nodes = X.parts(spark, sf)
    sel = numeric_selectors(nodes, "p_size", intervals_only=False)
    return cover(nodes, "node_id", sel).select(F.explode("ids").alias("sg")).groupBy("sg").agg(F.count("*").alias("n")).join(F.broadcast(selector_table(spark, sel)), "sg").select("descr", "n")


SDQ = {name: _sd(e) for name, (e, _) in SD.items()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [graph_density, graph_margins, graph_degree_hist, prior_uniform, prior_degree, prior_degree_directed, prior_rectangular, prior_block, pattern_update, selectors_nominal, selectors_numeric, selectors_auto, numeric_one_sided, quartile_store, vote_store, sgd_si_level1, sgd_si_beam, attribute_sweep, sgd_iaodf, bi_beam, bi_beam_constrained, sd_stats_numeric, sd_standard_numeric, sd_dfs_numeric_bound, post_minimum_quality, post_unique_attributes, post_jaccard, post_roc, enrichment_fisher, summary_split_scores, summary_blocks, block_density, tags_topk, multihot, country_tokens, json_explode, coo_sum, subsample, topics_pca, clusters, dbscan, mrd_rows]
    return {
        **{f.__name__: f for f in own},
        **{name: _measure(e, t) for name, (e, t, _) in MEASURES.items()},
        **SDQ,
        "bi_si_level1": lambda spark, sf: _pairs(spark, sf, False),
        "bi_si_constrained": lambda spark, sf: _pairs(spark, sf, True),
        "sd_stats_nominal": lambda spark, sf: _stats(_nominal_counts(spark, sf)),
        "sd_stats_weighted": lambda spark, sf: _stats(_nominal_counts(spark, sf, "l_quantity")),
        "sd_ga_standard": _generalisation,
        "sd_apriori": _search(search.apriori),
        "sd_best_first": _search(search.best_first),
        "sd_dfs": _search(search.simple_dfs),
        "sd_bitset": _search(search.bitset_search),
        "sd_tid": _search(search.tid_search),
    }


def oracle_sql() -> dict[str, str]:
    marg = f"WITH {_SUCC} "
    und = f"WITH {GRAPH}, d AS (SELECT p_partkey AS node, coalesce(c, 0)::BIGINT AS deg FROM part LEFT JOIN (SELECT src AS p_partkey, count(*) AS c FROM edges GROUP BY 1) USING (p_partkey)) "
    topk = {name: TOPK_SQL for name in ("sd_apriori", "sd_best_first", "sd_dfs", "sd_bitset", "sd_tid")}
    lower = ", ".join(f"'{c}'" for c in prep.COUNTRIES)
    return {
        "graph_density": f"WITH {GRAPH} SELECT nn::BIGINT AS nodes, m::BIGINT AS edges, {_P} AS density FROM tot",
        "graph_margins": marg + "SELECT * FROM marg",
        "graph_degree_hist": marg + "SELECT out_degree, in_degree, count(*)::BIGINT AS n FROM marg GROUP BY ALL",
        "prior_uniform": f"WITH {GRAPH} SELECT round(ln({_P} / (1 - {_P})), 9) AS logit FROM tot",
        "prior_degree": und + "SELECT deg AS out_degree, deg AS in_degree, count(*)::BIGINT AS n, deg::DOUBLE AS expected_out, deg::DOUBLE AS expected_in FROM d GROUP BY deg",
        "prior_degree_directed": marg + "SELECT out_degree, in_degree, count(*)::BIGINT AS n, out_degree::DOUBLE AS expected_out, in_degree::DOUBLE AS expected_in FROM marg GROUP BY ALL",
        "prior_rectangular": "WITH c AS (SELECT DISTINCT o_custkey AS r, l_suppkey AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey) SELECT d AS degree, count(*)::BIGINT AS n, d::DOUBLE AS expected FROM (SELECT r, count(*)::BIGINT AS d FROM c GROUP BY 1) GROUP BY d",
        "prior_block": f"WITH {GRAPH} SELECT x.p_type AS a, y.p_type AS b, count(*)::DOUBLE AS expected FROM edges JOIN part x ON x.p_partkey = src JOIN part y ON y.p_partkey = dst GROUP BY ALL",
        "pattern_update": f"WITH {GRAPH} SELECT descr, k::BIGINT AS k, k::DOUBLE AS expected FROM stats",
        "selectors_nominal": f"WITH {GRAPH} SELECT descr, n::BIGINT AS n FROM stats",
        "selectors_numeric": " UNION ALL ".join(_CUTS_SQL.format(c=c) for c in ("p_size", "p_retailprice")),
        "quartile_store": " UNION ALL ".join(f"SELECT ({b} + i - 1)::INT AS cut, (SELECT count(*) FROM part WHERE {c} < v)::BIGINT AS n FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS r, count(*) OVER () AS t FROM part), (SELECT unnest([1, 2, 3]) AS i) WHERE r = (t / 4 * i)::BIGINT" for b, c in ((0, "p_size"), (3, "p_retailprice"))),
        "vote_store": " UNION ALL ".join(f"SELECT {i}::INT AS cut, count(*)::BIGINT AS n FROM customer WHERE {c}" for i, c in enumerate(("c_acctbal >= 0", "c_acctbal <= 0", "c_acctbal >= 4500", "c_acctbal <= 4500"))),
        "sgd_si_level1": f"WITH {GRAPH} SELECT descr, n::BIGINT AS n, k::BIGINT AS k, {_SI1} AS si FROM stats, tot",
        "sgd_si_beam": BEAM_SQL,
        "attribute_sweep": SWEEP_SQL,
        "sgd_iaodf": f"WITH {GRAPH}, e AS (SELECT src AS node, dst AS other FROM edges UNION ALL SELECT dst, src FROM edges), d AS (SELECT s.descr, e.node, count(*)::DOUBLE AS deg, count(o.descr)::DOUBLE AS ins FROM e JOIN covers s USING (node) LEFT JOIN covers o ON o.node = e.other AND o.descr = s.descr GROUP BY ALL) SELECT descr, round(1 - coalesce(x, 0) / n, 6) AS value FROM stats LEFT JOIN (SELECT descr, sum((deg - ins) / deg) AS x FROM d GROUP BY 1) USING (descr)",
        **{name: f"WITH {GRAPH} SELECT descr, round({sql}, 6) AS value FROM stats, tot" for name, (_, _, sql) in MEASURES.items()},
        "bi_si_level1": _pairs_sql(False),
        "bi_si_constrained": _pairs_sql(True),
        "sd_stats_nominal": _stats_sql("nn", "pos", "n_sg", "pos_sg"),
        "sd_stats_weighted": _stats_sql("ww", "wpos", "w_sg", "wpos_sg"),
        "sd_stats_numeric": f"WITH {_ROWS}, g AS (SELECT avg(x) AS m, median(x) AS md FROM rowsx), s AS (SELECT descr, count(*)::BIGINT AS size_sg, avg(x) AS a, stddev_pop(x) AS sd, median(x) AS me, max(x) AS ma, min(x) AS mi FROM (SELECT unnest(ids) AS descr, x FROM rowsx) GROUP BY 1) SELECT descr, size_sg, round(a, 4) AS mean_sg, round(sd, 4) AS std_sg, round(me, 4) AS median_sg, round(ma, 4) AS max_sg, round(mi, 4) AS min_sg, round(a / m, 6) AS mean_lift, round(me / md, 6) AS median_lift FROM s, g",
        **{name: f"WITH {_ROWS} SELECT descr, round(({sql})::DOUBLE, 6) AS quality FROM lv, tot" for name, (_, sql) in SD.items()},
        "sd_standard_numeric": f"WITH {_ROWS} SELECT descr, round(power(n_sg, 0.5) * (mean_sg - mean), 3) AS quality FROM lv, tot",
        "sd_dfs_numeric_bound": f"WITH {_ROWS}, u AS (SELECT unnest(ids) AS descr, w AS t FROM rowsx), v AS (SELECT descr, row_number() OVER z AS size, sum(t) OVER (PARTITION BY descr ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS total FROM u WHERE descr NOT LIKE 'l_quantity%' WINDOW z AS (PARTITION BY descr ORDER BY t DESC)) SELECT descr, round(max(size * (total / size - (SELECT avg(w) FROM rowsx))), 3) AS bound FROM v GROUP BY 1",
        "sd_ga_standard": GA_SQL.replace(", (SELECT 1) JOIN", " JOIN"),
        **topk,
        "post_minimum_quality": f"WITH {_ROWS}, q AS (SELECT descr, round({SD['sd_wracc'][1]}, 6) AS quality FROM lv, tot) SELECT * FROM q WHERE quality >= 0",
        "post_unique_attributes": f"WITH {_ROWS}, q AS (SELECT descr, round({SD['sd_wracc'][1]}, 6) AS quality FROM lv, tot), r AS (SELECT *, row_number() OVER (PARTITION BY regexp_extract(descr, '^(\\w+)', 1) ORDER BY quality DESC, descr) AS x FROM q) SELECT descr, quality FROM r WHERE x = 1 OR descr LIKE 'l_linestatus%'",
        "post_jaccard": f"WITH {_ROWS}, p AS (SELECT a AS descr, b AS descr2, count(*) AS c FROM (SELECT rid, unnest(ids) AS a FROM rowsx) JOIN (SELECT rid, unnest(ids) AS b FROM rowsx) USING (rid) WHERE a < b GROUP BY ALL) SELECT p.descr, p.descr2, round(c::DOUBLE / (x.n_sg + y.n_sg - c), 9) AS jaccard FROM p JOIN lv x ON x.descr = p.descr JOIN lv y ON y.descr = p.descr2",
        "post_roc": f"WITH {_ROWS} SELECT descr, round((n_sg - pos_sg) / (nn - pos), 9) AS fpr, round(pos_sg / pos, 9) AS tpr FROM lv, tot",
        "enrichment_fisher": FISHER_SQL,
        "summary_split_scores": SPLIT_SQL,
        "summary_blocks": _summary_sql(3),
        "selectors_auto": _AUTO_SQL,
        "block_density": BLOCK_SQL,
        "tags_topk": f"WITH {_TAGS} SELECT tag, n::BIGINT AS n FROM top",
        "multihot": f"WITH {_TAGS} SELECT DISTINCT id, tag FROM t JOIN top USING (tag)",
        "country_tokens": f"WITH w AS (SELECT n_nationkey AS id, upper(n_name[1]) || lower(n_name[2:]) AS c FROM nation) SELECT id, c AS country FROM w WHERE c IN ({lower}) UNION SELECT id, 'United States' FROM w",
        "json_explode": "SELECT event_type, 'k' AS key, count(*)::BIGINT AS n, round(sum(json_extract_string(props, '$.k')::DOUBLE), 4) AS total FROM events GROUP BY 1",
        "coo_sum": "SELECT l_partkey % 50 AS row, l_suppkey % 20 AS col, sum(l_quantity) AS value FROM lineitem GROUP BY ALL",
        "subsample": "SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r % 8 = 0",
        "dbscan": "WITH p AS (SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice / 40 AS y FROM part) SELECT a.p_partkey, count(*)::BIGINT AS neighbours FROM p a JOIN p b ON power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 1 GROUP BY 1 HAVING count(*) >= 3",
        "mrd_rows": "SELECT 'l_returnflag' AS relation, l_returnflag AS col_id, count(DISTINCT l_suppkey)::BIGINT AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, count(DISTINCT l_suppkey) FROM lineitem GROUP BY 2",
        "numeric_one_sided": "SELECT CASE WHEN s = 0 THEN 'p_size<' || v ELSE 'p_size>=' || v END AS descr, (CASE WHEN s = 0 THEN (SELECT count(*) FROM part WHERE p_size < v) ELSE (SELECT count(*) FROM part WHERE p_size >= v) END)::BIGINT AS n FROM (SELECT value::INT AS v FROM (" + _CUTS_SQL.format(c="p_size") + ")), (SELECT unnest([0, 1]) AS s)",
    }
