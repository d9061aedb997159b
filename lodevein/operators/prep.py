"""Preparation of attributes: tags, countries, vote and quartile supports, topic projection, clusters."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import product
from operator import add, and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Countries of one word and what other words stand for them.
COUNTRIES = ("Argentina", "Australia", "Austria", "Belgium", "Brazil", "Canada", "Chile", "China", "Denmark", "Egypt", "Finland", "France", "Germany", "Greece", "India", "Indonesia", "Iran", "Ireland", "Israel", "Italy", "Japan", "Kenya", "Mexico", "Morocco", "Netherlands", "Norway", "Peru", "Poland", "Portugal", "Romania", "Russia", "Singapore", "Spain", "Sweden", "Switzerland", "Thailand", "Turkey", "Ukraine", "Vietnam")
STATES = ("AK", "AL", "AR", "AS", "AZ", "CA", "CO", "CT", "DC", "DE", "FL", "GA", "GU", "HI", "IA", "ID", "IL", "IN", "KS", "KY", "LA", "MA", "MD", "ME", "MI", "MN", "MO", "MP", "MS", "MT", "NA", "NC", "ND", "NE", "NH", "NJ", "NM", "NV", "NY", "OH", "OK", "OR", "PA", "PR", "RI", "SC", "SD", "TN", "TX", "UT", "VA", "VI", "VT", "WA", "WI", "WV", "WY")
ALIASES = {"US": "United States", "USA": "United States", "America": "United States", "UK": "United Kingdom", "HK": "China", "Macao": "China", "Taiwan": "China"}


def top_tags(tags: DataFrame, k: int) -> DataFrame:
    """tag, n: the most frequent tags of tags(id, tag), ties by tag."""
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(k)


def multi_hot(tags: DataFrame, top: DataFrame) -> DataFrame:
    """id, tag: the distinct top tags of every id, in long form."""
    return tags.join(top.select("tag"), "tag").select("id", "tag").distinct()


def countries_of(orgs: DataFrame) -> DataFrame:
    """id, country: countries whose name is a word of orgs(id, org); a state stands for itself and for its country."""
    known = {**{c: [c] for c in COUNTRIES}, **{a: [c] for a, c in ALIASES.items()}, **{s: [s, "United States"] for s in STATES}}
    names = F.create_map(*[x for w, cs in known.items() for x in (F.lit(w), F.array(*map(F.lit, cs)))])
    words = orgs.select("id", F.explode(F.split(F.regexp_replace("org", "#TAB#", ""), r"\s+")).alias("w"))
    return words.select("id", F.explode(F.element_at(names, F.trim(F.col("w"), F.lit(" ,")))).alias("country")).distinct()


def ranked(rows: DataFrame, order: str) -> DataFrame:
    """``rows`` with their exact rank from 0 in a column rank, by offsets of range partitions; equal rows of the order rank in any order."""
    ranged = rows.repartitionByRange(order).withColumn("__p", F.spark_partition_id()).persist()
    sizes = {r["__p"]: r["count"] for r in ranged.groupBy("__p").count().collect()}
    before, run = {}, 0
    for p in sorted(sizes):
        before[p] = run
        run += sizes[p]
    if not before:
        return rows.withColumn("rank", F.lit(0).cast("long"))
    offset = F.create_map(*[x for p, s in before.items() for x in (F.lit(p), F.lit(s))])[F.col("__p")]
    return ranged.withColumn("rank", F.row_number().over(W.partitionBy("__p").orderBy(order)) - 1 + offset.cast("long")).drop("__p")


def subsample(rows: DataFrame, order: str, step: int) -> DataFrame:
    """Every ``step``-th row of the order."""
    return ranked(rows, order).filter(F.col("rank") % step == 0).drop("rank")


def votes_support(votes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """cut, node: for each vote in -1, 0, 1 who is at or over 0 (even numbers) and at or under 0 (odd ones)."""
    cuts = [F.when(F.col(c) >= 0, F.lit(2 * i)) for i, c in enumerate(columns)] + [F.when(F.col(c) <= 0, F.lit(2 * i + 1)) for i, c in enumerate(columns)]
    return votes.select(F.explode(F.array_compact(F.array(*cuts))).alias("cut"), F.col(key).alias("node"))


def quartile_support(rows: DataFrame, key: str, cuts: dict[str, list[float]]) -> DataFrame:
    """cut, node: nodes whose attribute is under a cut point; cuts are numbered through all attributes."""
    marks, i = [], 0
    for c, points in cuts.items():
        for p in points:
            marks.append(F.when(F.col(c) < F.lit(p), F.lit(i)))
            i += 1
    return rows.select(F.explode(F.array_compact(F.array(*marks))).alias("cut"), F.col(key).alias("node"))


def principal_axes(vectors: DataFrame, key: str, column: str, k: int) -> DataFrame:
    """key, topics: projection of centred vectors on their k leading axes, each axis with its largest weight positive."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.filter(F.col(column).isNotNull()).select(key, array_to_vector(F.col(column).cast("array<double>")).alias("v"))
    centred = StandardScaler(inputCol="v", outputCol="c", withMean=True, withStd=False).fit(v).transform(v)
    model = PCA(k=k, inputCol="c", outputCol="t").fit(centred)
    axes = model.pc.toArray()
    signs = [1.0 if axes[abs(axes[:, i]).argmax(), i] >= 0 else -1.0 for i in range(k)]
    return model.transform(centred).select(key, F.zip_with(vector_to_array("t"), F.array(*map(F.lit, signs)), lambda a, b: a * b).alias("topics"))


def k_means(vectors: DataFrame, key: str, column: str, k: int, seed: int = 0) -> tuple[DataFrame, float]:
    """(key, cluster) of unit vectors, and their silhouette."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    v = vectors.select(key, array_to_vector(F.col(column).cast("array<double>")).alias("v"))
    unit = Normalizer(inputCol="v", outputCol="features").transform(v)
    made = KMeans(k=k, seed=seed, predictionCol="cluster").fit(unit).transform(unit)
    return made.select(key, "cluster"), ClusteringEvaluator(predictionCol="cluster").evaluate(made)


def dbscan_cores(points: DataFrame, key: str, columns: list[str], eps: float, least: int = 10) -> DataFrame:
    """key, neighbours: points with ``least`` others or more within ``eps`` (themselves count), through a grid."""
    counts = _neighbours(_positions(points, key, columns), len(columns), eps)
    rows = points.select(key, F.array(*[F.col(c).cast("double") for c in columns]).alias("at")).hint("merge")  # files of many copies look small enough to broadcast
    rows = rows.join(counts.select("at", "neighbours"), "at")
    return rows.groupBy(key).agg(F.sum("neighbours").alias("neighbours")).filter(F.col("neighbours") >= least)


def dbscan(points: DataFrame, key: str, columns: list[str], eps: float, least: int = 10) -> DataFrame:
    """key, cluster, core: clusters are cores that hang together, named by their smallest key; border points join the smallest of theirs; noise has null.

    Cores of one place in a fine grid hang together and are one node, so that links grow with the places taken, not with pairs.
    """
    counts = _materialised(_neighbours(_positions(points, key, columns), len(columns), eps))
    placed = _around(counts.select("at", (F.col("neighbours") >= least).alias("core")), len(columns), eps)
    width = _width(len(columns), eps)

    def tie(group: pa.Table) -> pa.Table:
        return _ties(group, width, eps * eps)

    ties = _materialised(placed.groupBy("cell").applyInArrow(tie, "kind int, a array<double>, b array<double>"))
    links = ties.filter(F.col("kind") == LINK).select("a", "b")
    inner = _materialised(links.union(links.select("b", "a")))
    label = _materialised(ties.filter(F.col("kind") == CORE).select(F.col("b").alias("block"), F.col("b").alias("top")).distinct())
    while True:  # each round takes the smallest label around, and that label's own
        around = inner.join(label.select(F.col("block").alias("b"), F.col("top").alias("c")), "b").groupBy(F.col("a").alias("block")).agg(F.min("c").alias("c"))
        up = around.join(label.select(F.col("block").alias("c"), F.col("top").alias("over")), "c", "left").select("block", F.least("c", "over").alias("c"))
        new = _materialised(label.withColumnRenamed("top", "old").join(up, "block", "left").select("block", F.least("old", F.coalesce("c", "old")).alias("top"), "old"))
        label = new.select("block", "top")
        if new.filter("top != old").isEmpty():
            break
    member = ties.filter(F.col("kind") != LINK).select("kind", F.col("a").alias("at"), F.col("b").alias("block")).join(label, "block")
    names = member.filter(F.col("kind") == CORE).join(counts.select("at", "first"), "at").groupBy("top").agg(F.min("first").alias("cluster"))
    found = member.join(names, "top").groupBy("at").agg(F.min("cluster").alias("cluster"), F.bool_or(F.col("kind") == CORE).alias("core"))
    rows = points.select(key, F.array(*[F.col(c).cast("double") for c in columns]).alias("at"))
    return rows.join(found, "at", "left").select(key, "cluster", F.coalesce("core", F.lit(False)).alias("core"))


def _materialised(df: DataFrame) -> DataFrame:
    from lodevein.operators.model import _cut

    return _cut(df)


#: Kinds of ties: a core and its block, a point near a block of cores, two blocks.
CORE, BORDER, LINK = 0, 1, 2
#: Pairs of points that are compared at once.
PAIRS = 1 << 16


def _positions(points: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """at, n, first: distinct finite positions, how many points stand there, and their smallest key."""
    finite = [F.abs(F.col(c).cast("double")) < float("inf") for c in columns]
    return points.filter(reduce(and_, finite)).groupBy(F.array(*[F.col(c).cast("double") for c in columns]).alias("at")).agg(F.count("*").alias("n"), F.min(key).alias("first"))


def _width(dimensions: int, eps: float) -> float:
    """The side of a place, of which points are about ``eps`` apart at most."""
    return eps / math.sqrt(dimensions) * (1 - 1e-9) or 1.0


def _around(positions: DataFrame, dimensions: int, eps: float) -> DataFrame:
    """Positions in their own cell and all neighbours of it (own: whether it is theirs).  Cells are whole places, wider than ``eps``."""
    places = math.isqrt(dimensions) + 1
    most = float(1 << 60)
    cell = lambda i: F.floor(F.least(F.greatest(F.floor(F.col("at")[i].cast("double") / _width(dimensions, eps)) / places, F.lit(-most)), F.lit(most)))
    steps = list(product((-1, 0, 1), repeat=dimensions))
    near = F.array(*[F.struct(F.array(*[cell(i) + d for i, d in enumerate(s)]).alias("cell"), F.lit(not any(s)).alias("own")) for s in steps])
    return positions.select("*", F.explode(near).alias("c")).select("c.cell", "c.own", *positions.columns)


def _neighbours(positions: DataFrame, dimensions: int, eps: float) -> DataFrame:
    """at, first, neighbours: points within ``eps`` of every position."""

    def count(group: pa.Table) -> pa.Table:
        x, own = _coordinates(group), group.column("own").to_numpy()
        mine = np.flatnonzero(own)
        total = np.zeros(len(x), np.int64)
        if len(mine):
            _add_near(x, group.column("n").to_numpy(), mine, np.arange(len(x)), eps * eps, total)
        return group.select(["at"]).filter(pa.array(own)).append_column("neighbours", pa.array(total[mine], pa.int64()))

    sums = _around(positions.select("at", "n"), dimensions, eps).groupBy("cell").applyInArrow(count, "at array<double>, neighbours long")
    return positions.select("at", "first").join(sums, "at")


def _coordinates(group: pa.Table) -> np.ndarray:
    return group.column("at").combine_chunks().flatten().to_numpy().reshape(len(group), -1)


def _square(d: np.ndarray) -> np.ndarray:
    return reduce(add, (d[..., i] * d[..., i] for i in range(d.shape[-1])), 0.0)


def _bounds(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distances between boxes.  Rounding keeps order, so they bound those of the points as computed, too."""
    return _square(np.maximum(np.maximum(low - other_high, other_low - high), 0.0)), _square(np.maximum(high - other_low, other_high - low))


def _halves(x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = x[rows]
    rows = rows[np.argsort(own[:, np.argmax(own.max(0) - own.min(0))], kind="stable")]
    return rows[: len(rows) // 2], rows[len(rows) // 2 :]


def _decided(x: np.ndarray, left: np.ndarray, right: np.ndarray, bar: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Blocks of left and right rows that are near as a whole (None), or for which of their pairs are; boxes that can't be near are left out."""
    todo = [(left, right)]
    while todo:
        a, b = todo.pop()
        near, far = _bounds(x[a].min(0), x[a].max(0), x[b].min(0), x[b].max(0))
        if near > bar:
            continue
        if far <= bar:
            yield a, b, None
        elif len(a) * len(b) <= PAIRS:
            yield a, b, _square(x[a][:, None] - x[b][None]) <= bar
        elif len(a) >= len(b):
            todo += [(h, b) for h in _halves(x, a)]
        else:
            todo += [(a, h) for h in _halves(x, b)]


def _add_near(x: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray, bar: float, total: np.ndarray) -> None:
    """Adds to the total of each left row the weights of the right ones near it."""
    for a, b, hit in _decided(x, left, right, bar):
        total[a] += weight[b].sum() if hit is None else hit @ weight[b]


def _blocks(x: np.ndarray, rows: np.ndarray, width: float, bar: float) -> list[np.ndarray]:
    """Rows by place; what is too wide to be near as a whole is halved."""
    _, place = np.unique(np.floor(x[rows] / width), axis=0, return_inverse=True)
    order = np.argsort(place.reshape(-1), kind="stable")
    todo = np.split(rows[order], np.flatnonzero(np.diff(place.reshape(-1)[order])) + 1)
    out = []
    while todo:
        r = todo.pop()
        if len(r) == 1 or _bounds(x[r].min(0), x[r].max(0), x[r].min(0), x[r].max(0))[1] <= bar:
            out.append(np.sort(r))
        else:
            todo += _halves(x, r)
    return out


def _ties(group: pa.Table, width: float, bar: float) -> pa.Table:
    """Ties of a cell's own points; a block is named by its first position."""
    x = _coordinates(group)
    order = np.lexsort(x.T[::-1])
    x, own, core = x[order], group.column("own").to_numpy()[order], group.column("core").to_numpy()[order]
    kinds, ends, names = [], [], []

    def put(kind: int, a: np.ndarray, b: int) -> None:
        kinds.append(np.full(len(a), kind, np.int32))
        ends.append(a)
        names.append(np.full(len(a), b))

    blocks = sorted(_blocks(x, np.flatnonzero(core), width, bar), key=lambda r: r[0]) if core.any() and own.any() else []
    low, high = (np.array([f(x[r], 0) for r in blocks]) for f in (np.min, np.max))
    rest = np.flatnonzero(own & ~core)
    for k, r in enumerate(blocks):
        if len(rest):
            near = np.zeros(len(x), bool)
            for a, _, hit in _decided(x, rest, r, bar):
                near[a] |= True if hit is None else hit.any(1)
            put(BORDER, np.flatnonzero(near), r[0])
        if own[r[0]]:  # places don't reach over cells
            put(CORE, r, r[0])
            for j in np.flatnonzero(_bounds(low[k], high[k], low[:k], high[:k])[0] <= bar).tolist():
                if any(hit is None or hit.any() for _, _, hit in _decided(x, r, blocks[j], bar)):
                    put(LINK, r[:1], blocks[j][0])
    if not kinds:
        return pa.table({"kind": pa.array([], pa.int32()), "a": pa.array([], pa.list_(pa.float64())), "b": pa.array([], pa.list_(pa.float64()))})
    named = lambda rows: pa.array(list(x[np.concatenate(rows)]), pa.list_(pa.float64()))
    return pa.table({"kind": np.concatenate(kinds), "a": named(ends), "b": named(names)})
