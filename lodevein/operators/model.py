"""A background model as an object: probabilities of cells, expected edges of groups, and updates by patterns.

Nodes of one class are exchangeable, so the model is a table of logits for pairs of classes (bounded by ``prior.MOST_CLASSES``
squared, which is checked) and a relation of nodes and classes that stays in Spark.  A pattern that is stored splits the classes
by membership and shifts the logits of its cells.

Cells hold weights of a family (``functions.families``): edges or none (bernoulli), counts (geometric), or amounts (exponential).  Probabilities, expected
edges and logits then are means, expected weights and natural parameters; ``k`` of a pattern is the sum of weights observed in it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodevein.functions import families
from lodevein.operators import prior
from lodevein.operators.graph_stats import margins

#: Cells of the table of right-hand groups by classes that pair scores take to the tasks.
MOST_CELLS = 1 << 24


def _cut(df: DataFrame) -> DataFrame:
    """Lineage ends here where a checkpoint folder is set."""
    context = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir() and folder:
        context.setCheckpointDir(folder)
    return df.checkpoint() if context.getCheckpointDir() else df


def _exploded(groups: DataFrame, name: str) -> DataFrame:
    """node, size, group: a node that stands for several has their number as its size."""
    size = F.col("size") if "size" in groups.columns else F.lit(1).cast("long")
    return groups.select("node", size.alias("size"), F.explode("ids").alias(name))


@dataclass
class Background:
    """``logit`` by class pair, ``nodes`` (node, class), the parameters of the patterns stored so far, and the family of the weights."""

    logit: np.ndarray
    nodes: DataFrame
    undirected: bool = True
    lambdas: list[float] = field(default_factory=list)
    family: str = "bernoulli"

    def probabilities(self) -> np.ndarray:
        """Mean weight of a cell by class pair."""
        return families.family_of(self.family).mean(self.logit)

    def expected(self, groups: DataFrame) -> DataFrame:
        """sg, p: expected edges inside groups(node, ids); a node has none with itself."""
        shared = self.nodes.sparkSession.sparkContext.broadcast(self.probabilities())

        def one(group: pa.Table) -> pa.Table:
            c, n = group.column("class").to_numpy(), group.column("n").to_numpy().astype(float)
            own = shared.value[np.ix_(c, c)]
            return pa.table({"sg": group.column("sg")[:1], "p": [float(n @ own @ n - n @ np.diag(own))]})

        counts = _exploded(groups, "sg").join(self.nodes, "node").groupBy("sg", "class").agg(F.sum("size").alias("n"))
        return counts.groupBy("sg").applyInArrow(one, "sg int, p double")

    def expected_pairs(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """a, b, p: expected edges from group a to group b, for all pairs of groups that have members."""
        spark = self.nodes.sparkSession
        count = lambda g, name: _exploded(g, name).join(self.nodes, "node").groupBy(name, "class").agg(F.sum("size").alias("n"))
        rows = count(right, "b").limit(MOST_CELLS + 1).collect()
        names = sorted({r["b"] for r in rows})
        if len(names) * len(self.logit) > MOST_CELLS:
            raise ValueError(f"more than {MOST_CELLS} cells of groups and classes; split the groups on the right")
        table = np.zeros((len(names), len(self.logit)))
        at = {b: i for i, b in enumerate(names)}
        for r in rows:
            table[at[r["b"]], r["class"]] = r["n"]
        shared = spark.sparkContext.broadcast((np.array(names, np.int32), self.probabilities() @ table.T))

        def one(group: pa.Table) -> pa.Table:
            b, reach = shared.value
            p = group.column("n").to_numpy().astype(float) @ reach[group.column("class").to_numpy()]
            return pa.table({"a": np.full(len(b), group.column("a")[0].as_py(), np.int32), "b": b, "p": p})

        cells = count(left, "a").groupBy("a").applyInArrow(one, "a int, b int, p double")
        alone = spark.createDataFrame([(i, float(p)) for i, p in enumerate(np.diag(self.probabilities()))], "class int, self double")
        common = _exploded(left, "a").join(_exploded(right, "b").drop("size"), "node").join(self.nodes, "node").join(alone, "class").groupBy("a", "b").agg(F.sum(F.col("self") * F.col("size")).alias("self"))
        return cells.join(common, ["a", "b"], "left").select("a", "b", (F.col("p") - F.coalesce("self", F.lit(0.0))).alias("p"))

    def cells(self, pairs: DataFrame) -> DataFrame:
        """src, dst, p of pairs(src, dst); 0 for a node with itself."""
        return self._placed(pairs, self.probabilities()).select("src", "dst", F.when(F.col("src") == F.col("dst"), 0.0).otherwise(F.col("value")).alias("p"))

    def _placed(self, pairs: DataFrame, table: np.ndarray) -> DataFrame:
        """Pairs with the value that a table of class pairs has for them."""
        n = len(table)
        at = pa.table({"ci": np.repeat(np.arange(n, dtype=np.int32), n), "cj": np.tile(np.arange(n, dtype=np.int32), n), "value": table.reshape(-1)})
        end = lambda c, i: self.nodes.select(F.col("node").alias(c), F.col("class").alias(i))
        return pairs.join(end("src", "ci"), "src").join(end("dst", "cj"), "dst").join(self.nodes.sparkSession.createDataFrame(at), ["ci", "cj"])

    def likelihood(self, pairs: DataFrame, weight: str = "weight") -> DataFrame:
        """src, dst, weight, log_likelihood of pairs(src, dst, weight): of the observed weight, 0 where there is none, under the model.

        A node has no weight with itself.  Natural parameters of -inf make 0 of weight 0, and -inf of any other.
        """
        return _likelihood(self.family, self._placed(pairs, self.logit), F.col("value"), weight)

    def row(self, node: int) -> DataFrame:
        """Probabilities of the cells from a node to all."""
        return self._line(node, self.probabilities(), "src", "dst")

    def column(self, node: int) -> DataFrame:
        """Probabilities of the cells from all nodes to one."""
        return self._line(node, self.probabilities().T, "dst", "src")

    def _line(self, node: int, table: np.ndarray, own: str, other: str) -> DataFrame:
        """Cells of one node with all, by its row of the table: its class is looked up, so that no task takes all pairs of one key."""
        at = self.nodes.filter(F.col("node") == node).select("class").first()
        line = table[at["class"]] if at else table[0]
        named = self.nodes.sparkSession.createDataFrame(pa.table({"class": np.arange(len(line), dtype=np.int32), "value": line}))
        nodes = self.nodes if at else self.nodes.filter(F.lit(False))
        cells = nodes.join(F.broadcast(named), "class").select(F.lit(node).cast("long").alias(own), F.col("node").alias(other), "value")
        return cells.select("src", "dst", F.when(F.col("src") == F.col("dst"), 0.0).otherwise(F.col("value")).alias("p"))

    def dense(self) -> DataFrame:
        """All cells, lazily; as many rows as pairs of nodes."""
        return self.cells(self.nodes.select(F.col("node").alias("src")).crossJoin(self.nodes.select(F.col("node").alias("dst"))))

    def _refined(self, left: DataFrame, right: DataFrame | None) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nodes by new classes; old class, size, and membership on both sides of each."""
        flag = lambda g, name: g.select("node").distinct().withColumn(name, F.lit(True))
        nodes = self.nodes.join(flag(left, "in_a"), "node", "left")
        nodes = nodes.withColumn("in_b", F.col("in_a")) if right is None else nodes.join(flag(right, "in_b"), "node", "left")
        nodes = nodes.select("node", "class", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("in_a", "in_b")])
        keys = ["class", "in_a", "in_b"]
        rows = nodes.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(*keys).limit(prior.MOST_CLASSES + 1).collect()
        if len(rows) > prior.MOST_CLASSES:
            raise ValueError(f"more than {prior.MOST_CLASSES} classes of nodes")
        named = self.nodes.sparkSession.createDataFrame([(r["class"], r["in_a"], r["in_b"], i) for i, r in enumerate(rows)], "class int, in_a boolean, in_b boolean, new int")
        return (nodes.join(F.broadcast(named), keys).select("node", F.col("new").alias("class")), *(np.array([r[c] for r in rows]) for c in ("class", "n", "in_a", "in_b")))

    def pattern(self, left: DataFrame, right: DataFrame | None, k: int) -> tuple[Background, float, float, float]:
        """The model that expects ``k`` edges inside left (or from left to right); its parameter, the edges expected before, and the information content.

        In an undirected model a pattern of two groups holds in both orientations, so cells that lie in both shift twice.
        """
        nodes, old, n, a, b = self._refined(left, right)
        n = n.astype(float)
        logit = self.logit[np.ix_(old, old)]
        times = np.outer(a, b).astype(float)
        if right is not None and self.undirected:
            times += np.outer(b, a)
        cells = np.where(np.outer(a, b), np.outer(n, n) - np.diag(n), 0.0)
        before = float((cells * families.family_of(self.family).mean(logit)).sum())
        shift, gain = _shift(self.family, logit, cells, times, k)
        with np.errstate(invalid="ignore"):
            after = np.where(np.isneginf(logit), logit, logit + shift * times)
        return Background(after, nodes, self.undirected, [*self.lambdas, shift], self.family), shift, before, gain

    def contents(self, groups: DataFrame, sums: DataFrame) -> DataFrame:
        """sg, k, expected, shift, ic: what each of the groups(node, ids) alone would tell as a pattern with sums(sg, k) inside; nothing is stored.

        One histogram of classes serves all groups, and each is solved in a task.
        """
        shared = self.nodes.sparkSession.sparkContext.broadcast(self.logit)
        family = self.family

        def one(group: pa.Table) -> pa.Table:
            c, n, k = (group.column(x).to_numpy() for x in ("class", "n", "k"))
            logit, n, k = shared.value[np.ix_(c, c)], n.astype(float), float(k[0])
            cells = np.outer(n, n) - np.diag(n)
            shift, ic = _shift(family, logit, cells, np.ones_like(cells), k)
            return pa.table({"sg": group.column("sg")[:1], "k": [k], "expected": [float((cells * families.family_of(family).mean(logit)).sum())], "shift": [float(shift)], "ic": [ic]})

        counts = _exploded(groups, "sg").join(self.nodes, "node").groupBy("sg", "class").agg(F.sum("size").alias("n"))
        return counts.join(sums.select("sg", F.col("k").cast("double").alias("k")), "sg").groupBy("sg").applyInArrow(one, "sg int, k double, expected double, shift double, ic double")

    def save(self, path: str) -> None:
        """Write the model so that a session can go on later."""
        spark = self.nodes.sparkSession
        table = [(i, j, float(self.logit[i, j])) for i in range(len(self.logit)) for j in range(len(self.logit))]
        spark.createDataFrame(table, "ci int, cj int, logit double").write.mode("overwrite").parquet(f"{path}/logits")
        stored = [(i, x, self.undirected, self.family) for i, x in enumerate(self.lambdas)] or [(-1, 0.0, self.undirected, self.family)]
        spark.createDataFrame(stored, "i int, lambda double, undirected boolean, family string").write.mode("overwrite").parquet(f"{path}/patterns")
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Background:
        cells = spark.read.parquet(f"{path}/logits").collect()
        logit = np.zeros((1 + max(r["ci"] for r in cells),) * 2)
        for r in cells:
            logit[r["ci"], r["cj"]] = r["logit"]
        stored = sorted(spark.read.parquet(f"{path}/patterns").collect())
        return Background(logit, spark.read.parquet(f"{path}/nodes"), stored[0]["undirected"], [r["lambda"] for r in stored if r["i"] >= 0], stored[0]["family"])


def _shift(family: str, logit: np.ndarray, cells: np.ndarray, times: np.ndarray, k: float) -> tuple[float, float]:
    """The parameter of a pattern that holds ``times`` in its cells (counts by class pair) and makes their expected sum ``k``, and the gain of likelihood."""
    f = families.family_of(family)
    some = (cells > 0) & np.isfinite(logit)
    total = cells[some].sum()
    if total == 0:
        return 0.0, 0.0
    low, high = -60.0, 60.0
    if f.top == 0:  # parameters stay below 0, however small a sum is asked for
        high = float((-logit[some] / times[some]).min())
        low = -max(60.0, 2 * total / max(k, 1e-9 * total))
    if k <= 0 or f.top > 0 and k >= total:
        shift = low if k <= 0 else high
    else:
        for _ in range(200):
            shift = (low + high) / 2
            x = logit[some] + shift * times[some]
            if (x < f.top).all() and (cells[some] * f.mean(x)).sum() < k:
                low = shift
            else:
                high = shift
    # Weights of the pattern are exchangeable within the cells of a class pair only in sum: the gain of likelihood needs just k.
    after = logit[some] + shift * times[some]
    return shift, float(k * shift - (cells[some] * (f.log_partition(after) - f.log_partition(logit[some]))).sum())


@dataclass
class Margins:
    """A degree prior of a directed graph with any number of joint classes: nodes(node, a, b) have a row and a column parameter.

    It says what is expected of cells and of groups; patterns aren't stored in it.
    """

    nodes: DataFrame
    family: str = "bernoulli"

    def _placed(self, pairs: DataFrame) -> DataFrame:
        return pairs.join(self.nodes.select(F.col("node").alias("src"), "a"), "src").join(self.nodes.select(F.col("node").alias("dst"), "b"), "dst")

    def cells(self, pairs: DataFrame) -> DataFrame:
        """src, dst, p of pairs(src, dst); 0 for a node with itself."""
        mean = families.family_of(self.family).mean_of(F.col("a") + F.col("b"))
        return self._placed(pairs).select("src", "dst", F.when(F.col("src") == F.col("dst"), 0.0).otherwise(mean).alias("p"))

    def likelihood(self, pairs: DataFrame, weight: str = "weight") -> DataFrame:
        """As ``Background.likelihood``."""
        return _likelihood(self.family, self._placed(pairs), F.col("a") + F.col("b"), weight)

    def expected(self, groups: DataFrame) -> DataFrame:
        """sg, p: expected edges inside groups(node, ids), from each group's histograms of both parameters; a node has none with itself."""
        f = families.family_of(self.family)

        def one(group: pa.Table) -> pa.Table:
            a, b, n = (group.column(c).to_numpy() for c in ("a", "b", "n"))
            (x, at), (y, to) = (np.unique(v, return_inverse=True) for v in (a, b))
            rows, columns = np.bincount(at, n), np.bincount(to, n)
            total = 0.0
            for lo in range(0, len(x), step := max(1, (1 << 22) // max(1, len(y)))):  # a slice of the table at a time
                total += float(rows[lo : lo + step] @ f.mean(x[lo : lo + step, None] + y[None, :]) @ columns)
            return pa.table({"sg": group.column("sg")[:1], "p": [total - float((n * f.mean(a + b)).sum())]})

        counts = _exploded(groups, "sg").join(self.nodes, "node").groupBy("sg", "a", "b").agg(F.sum("size").alias("n"))
        return counts.groupBy("sg").applyInArrow(one, "sg int, p double")


def _likelihood(family: str, placed: DataFrame, x: Column, weight: str) -> DataFrame:
    w = F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    x = F.when(F.col("src") == F.col("dst"), float("-inf")).otherwise(x)
    return placed.select("src", "dst", w.alias(weight), families.log_likelihood(families.family_of(family), w, x).alias("log_likelihood"))


def directed(nodes: DataFrame, edges: DataFrame, key: str = "node_id", family: str = "bernoulli", weight: str | None = None) -> Margins:
    """Expected margins are the degrees, or sums of weights; the driver sees a row for each pair of them that occurs."""
    found = margins(nodes, edges, key, weight)
    rows = found.groupBy("out_degree", "in_degree").agg(F.count("*").alias("n")).limit(prior.MOST_CELLS + 1).toArrow()
    if rows.num_rows > prior.MOST_CELLS:
        raise ValueError(f"more than {prior.MOST_CELLS} classes of nodes")
    sums = [rows.column(c).to_numpy() for c in ("out_degree", "in_degree", "n")]
    a, b = prior.fit_margins(*sums) if family == "bernoulli" and weight is None else prior.fit_weights(*sums, family)
    table = found.sparkSession.createDataFrame(pa.table({"out_degree": rows.column("out_degree"), "in_degree": rows.column("in_degree"), "a": a, "b": b}))
    return Margins(found.join(table, ["out_degree", "in_degree"]).select("node", "a", "b"), family)


def uniform(nodes: DataFrame, edges: DataFrame, key: str = "node_id", undirected: bool = True, family: str = "bernoulli", weight: str | None = None, once: bool = False) -> Background:
    """Every cell has the density of the graph, or its mean weight.  ``once``, as below: as of ``margins``."""
    n = nodes.count()
    m = edges.count() * (2 if once else 1) if weight is None else edges.agg(F.coalesce(F.sum(F.col(weight).cast("double")), F.lit(0.0))).first()[0]
    logit = np.array([[families.family_of(family).start(m / (n * (n - 1)))]])
    return Background(logit, nodes.select(F.col(key).alias("node"), F.lit(0).alias("class")), undirected, family=family)


def degree(nodes: DataFrame, edges: DataFrame, key: str = "node_id", undirected: bool = True, square: bool = True, family: str = "bernoulli", weight: str | None = None, once: bool = False) -> Background:
    """Expected margins are the degrees, or sums of weights."""
    found, rows = prior.degree_classes(_cut(margins(nodes, edges, key, weight, once)))
    sums = [np.array([r[c] for r in rows]) for c in ("out_degree", "in_degree", "n")]
    a, b = prior.fit_degrees(*sums, square=square) if family == "bernoulli" and weight is None else prior.fit_weights(*sums, family, square)
    kind = "long" if weight is None else "double"
    named = nodes.sparkSession.createDataFrame([(r["out_degree"], r["in_degree"], i) for i, r in enumerate(rows)], f"out_degree {kind}, in_degree {kind}, class int")
    with np.errstate(invalid="ignore"):
        logit = a[:, None] + b[None, :]
    return Background(np.nan_to_num(logit, nan=-np.inf, neginf=-np.inf), found.join(F.broadcast(named), ["out_degree", "in_degree"]).select("node", "class"), undirected, family=family)


def degree_and_blocks(nodes: DataFrame, edges: DataFrame, label: str, key: str = "node_id", undirected: bool = True, once: bool = False) -> Background:
    """Expected margins are the degrees, and expected edges between labels the observed ones."""
    kind = nodes.select(F.col(key).alias("node"), F.col(label).cast("string").alias("label"))
    found = _cut(margins(nodes, edges, key, once=once).join(kind, "node"))
    _, rows = prior.degree_classes(found, ["label"])
    names = sorted({r["label"] for r in rows})
    of = np.array([names.index(r["label"]) for r in rows])
    want = np.zeros((len(names), len(names)))
    for r in edges.join(kind.toDF("src", "x"), "src").join(kind.toDF("dst", "y"), "dst").groupBy("x", "y").count().collect():
        want[names.index(r["x"]), names.index(r["y"])] = r["count"]
    want = want + want.T if once else want
    a, b, g = prior.fit_blocks(rows, of, want)
    named = nodes.sparkSession.createDataFrame([(r["out_degree"], r["in_degree"], r["label"], i) for i, r in enumerate(rows)], "out_degree long, in_degree long, label string, class int")
    return Background(a[:, None] + b[None, :] + g[of][:, of], found.join(F.broadcast(named), ["out_degree", "in_degree", "label"]).select("node", "class"), undirected)


def fit(kind: str, nodes: DataFrame, edges: DataFrame, label: str | None = None, **options: object) -> Background:
    """The front door: ``uniform``, ``degree``, or ``blocks`` with a label."""
    if kind == "blocks":
        if label is None:
            raise ValueError("a prior of blocks needs a label")
        return degree_and_blocks(nodes, edges, label, **options)
    if kind not in ("uniform", "degree"):
        raise ValueError(f"unknown prior {kind!r}")
    return {"uniform": uniform, "degree": degree}[kind](nodes, edges, **options)
