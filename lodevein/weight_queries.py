"""Registered queries over models of weights, topics, clusters in many dimensions and relations, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevein import queries as Q0
from lodevein.functions.selectors import cover, nominal_selectors, selector_table
from lodevein.operators import graph_stats as G
from lodevein.operators import latent, metric, names
from lodevein.operators import model as M
from lodevein.sources import fixtures as X

# ---- weights under models --------------------------------------------------------------------------------------------------------


def cell_likelihood(spark: SparkSession, sf: str) -> DataFrame:
    """How likely is the weight of each succession of two users under the sums of their weights, as a count and as an amount; and that it repeats or doesn't."""
    nodes, edges = X.users(spark, sf), X.successions(spark, sf)
    with G.held(nodes, edges):
        again = edges.filter("weight > 1")
        models = {"bernoulli": M.directed(nodes, again), **{k: M.directed(nodes, edges, family=k, weight="weight") for k in ("geometric", "exponential")}}
        out = edges
        for name, model in models.items():
            seen = edges.select("src", "dst", (F.col("weight") > 1).cast("double").alias("weight")) if name == "bernoulli" else edges
            found = model.likelihood(seen).select("src", "dst", F.round("log_likelihood", 4).alias(name))
            out = out.join(found, ["src", "dst"])
        return out


def weight_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Weight inside each group of users, what the sums of weights expect of it, and the parameter and content of the group as a pattern of the uniform models."""
    nodes, edges = X.users(spark, sf), X.successions(spark, sf)
    with G.held(nodes, edges):
        sel = nominal_selectors(nodes, "event_type")
        groups = cover(nodes, "node_id", sel)
        inner = G.group_counts(edges, groups).select("sg", F.col("w_in").alias("k"))
        flat = [M.uniform(nodes, edges, undirected=False, family=f, weight="weight").contents(groups, inner).withColumn("family", F.lit(f)) for f in ("geometric", "exponential")]
        margin = M.directed(nodes, edges, family="geometric", weight="weight").expected(groups)
        out = flat[0].union(flat[1]).join(selector_table(spark, sel), "sg").join(margin, "sg")
        return out.select("descr", "family", F.col("k").alias("weight"), F.round("p", 3).alias("expected"), F.round("expected", 4).alias("uniform"), *[F.round(c, 4).alias(c) for c in ("shift", "ic")])


#: Mean, its slope, and logarithm of the partition function, of x.
_FAMILY = {
    "bernoulli": ("(1 / (1 + exp(-({x}))))", "(1 / (2 + exp({x}) + exp(-({x}))))", "ln(1 + exp({x}))"),
    "geometric": ("(1 / (exp(-({x})) - 1))", "(exp({x}) / power(1 - exp({x}), 2))", "(-ln(1 - exp({x})))"),
    "exponential": ("(-1 / ({x}))", "(1 / power({x}, 2))", "(-ln(-({x})))"),
}


def _solved(name: str, family: str, links: str, rounds: int) -> str:
    """CTEs: par_<name>(node, a, b) of a family under the sums of links(src, dst, weight), by alternating steps on rows and columns.

    A row's step is Newton's for the reciprocal of its sum, which stays where the family has a mean; of Bernoulli rows for the sum itself.
    """
    mean, slope, _ = _FAMILY[family]
    free = family == "bernoulli"

    def side(x: str, y: str, c: str, want: str) -> str:
        at = f"{x}[i] + {y}[j]"
        total = lambda f: f"list_sum(list_transform(range(1, len({y}) + 1), lambda j: CASE WHEN {c} = 0 THEN 0 ELSE {c} * {f.format(x=at)} END))"
        sums = f"list_transform(range(1, len({x}) + 1), lambda i: {{'x': {x}[i], 'g': {total(mean)}, 's': {total(slope)}, 'w': {want}[i], 'top': -list_max(list_transform(range(1, len({y}) + 1), lambda j: CASE WHEN {c} = 0 THEN NULL ELSE {y}[j] END))}})"
        step = "u.x + greatest(-1, least(1, (u.w - u.g) / u.s))" if free else "least((u.x + u.top) / 2, u.x + u.g * (1 - u.g / u.w) / u.s)"
        return f"list_transform({sums}, lambda u: {step})"

    n = name
    begin = "-0.5::DOUBLE" if not free else "0.0::DOUBLE"
    return f"""ms_{n} AS (SELECT node, coalesce(o, 0)::DOUBLE AS o, coalesce(i, 0)::DOUBLE AS i FROM us LEFT JOIN (SELECT src AS node, sum(weight) AS o FROM {links} GROUP BY 1) USING (node) LEFT JOIN (SELECT dst AS node, sum(weight) AS i FROM {links} GROUP BY 1) USING (node)
), r_{n} AS (SELECT o, count(*) AS c FROM ms_{n} WHERE o > 0 GROUP BY 1), k_{n} AS (SELECT i, count(*) AS c FROM ms_{n} WHERE i > 0 GROUP BY 1
), c_{n} AS (SELECT r.o, k.i, (r.c * k.c - coalesce(s.c, 0))::DOUBLE AS c FROM r_{n} r CROSS JOIN k_{n} k LEFT JOIN (SELECT o, i, count(*) AS c FROM ms_{n} GROUP BY ALL) s ON s.o = r.o AND s.i = k.i
), base_{n} AS (SELECT (SELECT list(o ORDER BY o) FROM r_{n}) AS os, (SELECT list(i ORDER BY i) FROM k_{n}) AS iz, (SELECT list(o * c ORDER BY o) FROM r_{n}) AS wr, (SELECT list(i * c ORDER BY i) FROM k_{n}) AS wk, (SELECT list(l ORDER BY o) FROM (SELECT o, list(c ORDER BY i) AS l FROM c_{n} GROUP BY 1)) AS cs
), it_{n} AS (SELECT 0 AS t, list_transform(os, lambda x: {begin}) AS a, list_transform(iz, lambda x: {begin}) AS b FROM base_{n}
  UNION ALL SELECT t + 1, a, {side("b", "a", "cs[j][i]", "wk")} FROM (SELECT t, {side("a", "b", "cs[i][j]", "wr")} AS a, b, wk, cs FROM it_{n}, base_{n} WHERE t < {rounds})
), pa_{n} AS (SELECT unnest(os) AS o, unnest(a) AS a FROM it_{n}, base_{n} WHERE t = {rounds}), pb_{n} AS (SELECT unnest(iz) AS i, unnest(b) AS b FROM it_{n}, base_{n} WHERE t = {rounds}
), par_{n} AS (SELECT node, a, b FROM ms_{n} LEFT JOIN pa_{n} USING (o) LEFT JOIN pb_{n} USING (i))"""


def _log(n: str, w: str) -> str:
    x = f"(x{n[0]}.a + y{n[0]}.b)"
    return f"round({w} * {x} - {_FAMILY[n][2].format(x=x)}, 4)"


_AT = " ".join(f"LEFT JOIN par_{n} x{n[0]} ON x{n[0]}.node = s.src LEFT JOIN par_{n} y{n[0]} ON y{n[0]}.node = s.dst" for n in _FAMILY)
_NEVER = "xb.a IS NULL OR yb.b IS NULL"
LIKELIHOOD_SQL = f"""WITH RECURSIVE {Q0._SUCC}, twice AS (SELECT src, dst, 1 AS weight FROM succ WHERE weight > 1),
{_solved("bernoulli", "bernoulli", "twice", 400)}, {_solved("geometric", "geometric", "succ", 400)}, {_solved("exponential", "exponential", "succ", 400)}
SELECT s.src, s.dst, s.weight, CASE WHEN {_NEVER} THEN 0 ELSE {_log("bernoulli", "(s.weight > 1)::INT")} END AS bernoulli, {_log("geometric", "s.weight")} AS geometric, {_log("exponential", "s.weight")} AS exponential FROM succ s {_AT}"""

_UNIFORM = {
    "geometric": ("ln(m / (1 + m))", "ln(k / (cells + k))", "-ln(1 - m / (1 + m))", "-ln(1 - k / (cells + k))"),
    "exponential": ("-1 / m", "-cells / k", "ln(m)", "ln(k / cells)"),
}


def _uniform(kind: str) -> str:
    before, after, low, high = _UNIFORM[kind]
    shift = f"CASE WHEN cells = 0 THEN 0 ELSE {after} - ({before}) END"
    gain = f"CASE WHEN cells = 0 THEN 0 ELSE k * ({after} - ({before})) - cells * ({high} - ({low})) END"
    return f"SELECT kind, '{kind}' AS family, k AS weight, cells * m AS uniform, {shift} AS shift, {gain} AS ic FROM g"


PATTERNS_SQL = f"""WITH RECURSIVE {Q0._SUCC}, {_solved("geometric", "geometric", "succ", 400)},
ty AS (SELECT user_id AS node, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY user_id, event_type),
mem AS (SELECT node, kind FROM ty WHERE r = 1), tot AS (SELECT s / (n * (n - 1)) AS m FROM (SELECT sum(weight) AS s FROM succ), (SELECT count(*) AS n FROM us)),
kk AS (SELECT x.kind, sum(weight) AS k FROM succ JOIN mem x ON x.node = src JOIN mem y ON y.node = dst AND y.kind = x.kind GROUP BY 1),
g AS (SELECT kind, cells, coalesce(k, 0) AS k, m FROM (SELECT kind, count(*)::DOUBLE * (count(*) - 1) AS cells FROM mem GROUP BY 1) LEFT JOIN kk USING (kind), tot),
e AS (SELECT x.kind, sum({_FAMILY["geometric"][0].format(x="p.a + q.b")}) AS p FROM mem x JOIN mem y ON x.kind = y.kind AND x.node <> y.node JOIN par_geometric p ON p.node = x.node JOIN par_geometric q ON q.node = y.node GROUP BY 1)
SELECT 'event_type=' || kind AS descr, family, weight, round(coalesce(p, 0), 3) AS expected, round(uniform, 4) AS uniform, round(shift, 4) AS shift, round(ic, 4) AS ic FROM ({_uniform("geometric")} UNION ALL {_uniform("exponential")}) LEFT JOIN e USING (kind)"""


# ---- clusters in many dimensions ---------------------------------------------------------------------------------------------------

#: Dimensions, distance and neighbours of the clusters of vectors.
DIMENSIONS, NEAR, LEAST = 50, 0.97, 3


def dbscan_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of vectors by their first fifty entries."""
    vectors = X.table(spark, sf, "embeddings").select("vec_id", F.slice("embedding", 1, DIMENSIONS).alias("v"))
    return metric.dbscan_vectors(vectors, "vec_id", "v", NEAR, LEAST)


DBSCAN_SQL = f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding[1:{DIMENSIONS}], lambda x: x::DOUBLE) AS v FROM embeddings),
near AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON list_distance(a.v, b.v) <= {NEAR}), cores AS (SELECT a AS c FROM near GROUP BY 1 HAVING count(*) >= {LEAST}),
links AS (SELECT a, b FROM near JOIN cores x ON x.c = a JOIN cores y ON y.c = b), reach AS (SELECT c AS a, c AS b FROM cores UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
tops AS (SELECT a AS c, min(b) AS top FROM reach GROUP BY 1), own AS (SELECT near.a, min(top) AS cluster FROM near JOIN tops ON tops.c = near.b GROUP BY 1)
SELECT vec_id, cluster, vec_id IN (SELECT c FROM cores) AS core FROM v LEFT JOIN own ON own.a = vec_id"""


# ---- latent topics of a sparse relation --------------------------------------------------------------------------------------------


def topics_lsa(spark: SparkSession, sf: str) -> DataFrame:
    """Singular values of the quantities that customers buy of brands, means taken off, and each customer's place on both axes (without its sign)."""
    lines = X.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("node"))
    brands = X.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("topic"))
    weights = lines.join(orders, "l_orderkey").join(brands, "l_partkey").groupBy("node", "topic").agg(F.sum("l_quantity").cast("double").alias("weight"))
    found = latent.latent_topics(weights, 2)
    values = [F.lit(x) for x in found.values] + [F.lit(0.0)] * (2 - len(found.values))
    place = lambda i: F.coalesce(F.abs(F.try_element_at("topics", F.lit(i))), F.lit(0.0))
    return found.nodes.select("node", *[F.round(v, 3).alias(f"value{i + 1}") for i, v in enumerate(values)], *[F.round(place(i), 2).alias(f"place{i}") for i in (1, 2)])


def _power(name: str, matrix: str, rounds: int) -> str:
    """CTEs: the leading unit vector v of a matrix (list of rows), and its value e."""
    times = lambda v: f"list_transform({matrix}, lambda r: list_sum(list_transform(range(1, len(r) + 1), lambda j: r[j] * {v}[j])))"
    return f"""p{name} AS (SELECT 0 AS t, list_transform({matrix}, lambda r: 1 + r[1] / list_sum(list_transform(r, lambda x: abs(x)))) AS v FROM m{name} UNION ALL
  SELECT t + 1, list_transform(u, lambda x: x / sqrt(list_sum(list_transform(u, lambda y: y * y)))) FROM (SELECT t, {times("v")} AS u FROM p{name}, m{name} WHERE t < {rounds})
), e{name} AS (SELECT v, sqrt(list_sum(list_transform({times("v")}, lambda x: x * x))) AS e FROM p{name}, m{name} WHERE t = {rounds})"""


LSA_SQL = f"""WITH RECURSIVE w AS (SELECT o_custkey AS node, p_brand AS topic, sum(l_quantity)::DOUBLE AS weight FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL),
nn AS (SELECT count(DISTINCT node)::DOUBLE AS n FROM w), mu AS (SELECT topic, sum(weight) / any_value(n) AS mean, row_number() OVER (ORDER BY topic) AS place FROM w, nn GROUP BY topic),
xy AS (SELECT a.topic AS x, b.topic AS y, sum(a.weight * b.weight) AS s FROM w a JOIN w b USING (node) GROUP BY ALL),
ma AS (SELECT list(r ORDER BY x) AS c FROM (SELECT a.topic AS x, list(coalesce(s, 0) - n * a.mean * b.mean ORDER BY b.topic) AS r FROM mu a CROSS JOIN mu b CROSS JOIN nn LEFT JOIN xy ON xy.x = a.topic AND xy.y = b.topic GROUP BY 1)),
{_power("a", "c", 3000)},
mb AS (SELECT list_transform(range(1, len(c) + 1), lambda i: list_transform(range(1, len(c) + 1), lambda k: c[i][k] - e * v[i] * v[k])) AS d FROM ma, ea),
{_power("b", "d", 3000)},
off AS (SELECT sum(mean * ea.v[place]) AS oa, sum(mean * eb.v[place]) AS ob FROM mu, ea, eb)
SELECT node, round(sqrt(any_value(ea.e)), 3) AS value1, round(sqrt(any_value(eb.e)), 3) AS value2, round(abs(sum(weight * ea.v[place]) - any_value(oa)), 2) AS place1, round(abs(sum(weight * eb.v[place]) - any_value(ob)), 2) AS place2 FROM w JOIN mu USING (topic), ea, eb, off GROUP BY node"""


# ---- names of several words ------------------------------------------------------------------------------------------------------


def country_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Countries in the addresses of suppliers: names are those of nations, and of their region and nation where the number is even."""
    nation = X.table(spark, sf, "nation").join(X.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    spoken = F.replace("n_name", F.lit("_"), F.lit(" "))
    known = nation.select(spoken.alias("name"), F.col("n_name").alias("value")).union(nation.filter("n_nationkey % 2 = 0").select(F.concat_ws(" ", "r_name", spoken), F.concat_ws("/", "r_name", "n_name")))
    address = F.concat("s_name", F.lit(", Institute of "), "r_name", F.lit(" "), spoken, F.lit(";"))
    texts = X.table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), address.alias("text"))
    return names.named_windows(texts, known)


WINDOWS_SQL = """SELECT s_suppkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN r_name || '/' || n_name ELSE n_name END AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (cell_likelihood, weight_patterns, dbscan_topics, topics_lsa, country_windows)}


def oracle_sql() -> dict[str, str]:
    return {"cell_likelihood": LIKELIHOOD_SQL, "weight_patterns": PATTERNS_SQL, "dbscan_topics": DBSCAN_SQL, "topics_lsa": LSA_SQL, "country_windows": WINDOWS_SQL}
