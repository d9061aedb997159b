"""Filters and tidy frames over result sets."""

from __future__ import annotations

import math
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodevein.functions.quality import standard


def minimum_quality(results: DataFrame, least: float) -> DataFrame:
    return results.filter(F.col("quality") >= least)


def statistic_between(results: DataFrame, statistic: str, least: float | None = None, most: float | None = None) -> DataFrame:
    out = results if least is None else results.filter(F.col(statistic) >= least)
    return out if most is None else out.filter(F.col(statistic) <= most)


def unique_attributes(results: DataFrame) -> DataFrame:
    """The best result of each set of attributes; sets of categorical attributes alone stay.  results(attributes, all_categorical, quality, descr, ...)."""
    first = F.row_number().over(W.partitionBy(F.array_sort("attributes")).orderBy(F.desc("quality"), "descr")) == 1
    return results.withColumn("__first", first).filter(F.col("__first") | F.col("all_categorical")).drop("__first")


def jaccard(groups: DataFrame) -> DataFrame:
    """a, b, jaccard of the covers of groups(node, ids), for groups that meet."""
    size = groups.select(F.explode("ids").alias("sg")).groupBy("sg").agg(F.count("*").alias("n"))
    pairs = groups.select("ids", F.explode("ids").alias("a")).select("a", F.explode("ids").alias("b")).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("common"))
    out = pairs.join(size.select(F.col("sg").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("sg").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("jaccard"))


def overlap_filter(ranked: list[int], similar: dict[tuple[int, int], float], level: float = 0.9) -> list[int]:
    """Results in order, without those that overlap an earlier kept one by more than ``level``."""
    kept: list[int] = []
    for x in ranked:
        if all(similar.get((min(x, y), max(x, y)), 0.0) <= level for y in kept):
            kept.append(x)
    return kept


def single_linkage(similar: dict[tuple[int, int], float]) -> list[tuple[int, int, float]]:
    """Merges of a dendrogram over distances 1 - similarity: a minimum spanning tree of the result set."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    out = []
    for (a, b), s in sorted(similar.items(), key=lambda p: (-p[1], p[0])):
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((min(a, b), max(a, b), 1 - s))
    return out


def proper_subsets(items: tuple) -> list[tuple]:
    """All subsets but the whole."""
    return list(chain.from_iterable(combinations(items, k) for k in range(len(items))))


def to_bits(numbers: list[int]) -> int:
    out = 0
    for n in numbers:
        out |= 1 << n
    return out


def rounded(results: DataFrame, digits: dict[str, int]) -> DataFrame:
    return results.withColumns({c: F.round(c, d) for c, d in digits.items()})


def latex(row: dict, columns: list[str]) -> str:
    return " & ".join(str(row[c]).replace(" AND ", r" $\wedge$ ") for c in columns) + r" \\"


def roc_points(results: DataFrame) -> DataFrame:
    """descr, fpr, tpr from n, pos, n_sg, pos_sg."""
    return results.select("descr", F.try_divide(F.col("n_sg") - F.col("pos_sg"), F.col("n") - F.col("pos")).alias("fpr"), F.try_divide("pos_sg", "pos").alias("tpr"))


#: Logarithms of the first factorials; from there on the series is exact to the last digits of a double.
_LOG_FACTORIALS = [math.lgamma(i + 1) for i in range(16)]


def log_factorial(n: Column) -> Column:
    """Stirling's series."""
    x = n.cast("double")
    tail = 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5))) - 1 / (1680 * F.pow(x, F.lit(7)))
    few = F.get(F.array(*map(F.lit, _LOG_FACTORIALS)), n.cast("int"))
    return F.when(n < len(_LOG_FACTORIALS), few).otherwise((x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + tail)


def fisher_two_sided(table: DataFrame) -> DataFrame:
    """p-values of 2 x 2 tables(a, b, c, d): the sum of the probabilities that don't exceed the observed one.

    Each possible a is a row, so tables with large margins are summed by parts.
    """
    f = log_factorial
    r1, r2, c1 = (F.col(c) for c in ("__r1", "__r2", "__c1"))
    t = table.withColumns({"__r1": F.col("a") + F.col("b"), "__r2": F.col("c") + F.col("d"), "__c1": F.col("a") + F.col("c"), "__id": F.monotonically_increasing_id()})
    t = t.withColumn("__all", f(r1) + f(r2) + f(c1) + f(r1 + r2 - c1) - f(r1 + r2))
    prob = lambda a: F.exp(F.col("__all") - f(a) - f(r1 - a) - f(c1 - a) - f(r2 - c1 + a))
    t = t.withColumn("__bar", prob(F.col("a")) * (1 + 1e-7)).withColumn("__k", F.explode(F.sequence(F.greatest(F.lit(0), c1 - r2), F.least(r1, c1))))
    t = t.withColumn("__p", prob(F.col("__k")))
    total = F.sum(F.when(F.col("__p") <= F.col("__bar"), F.col("__p")).otherwise(0.0))
    return t.groupBy("__id", *table.columns).agg(F.least(total, F.lit(1.0)).alias("p")).drop("__id")


def result_table(results: DataFrame, counts: DataFrame) -> DataFrame:
    """Results with the statistics of counts(descr, n, pos, n_sg, pos_sg)."""
    n, pos, a, b = (F.col(c).cast("double") for c in ("n", "pos", "n_sg", "pos_sg"))
    shares = {"relative_size_sg": a / n, "target_share_sg": F.try_divide(b, a), "target_share_complement": F.try_divide(pos - b, n - a), "lift": F.try_divide(F.try_divide(b, a), pos / n)}
    return results.select("rank", "quality", "descr").join(counts.select("descr", F.col("n_sg").alias("size_sg"), F.col("pos_sg").alias("positives_sg"), *[c.alias(x) for x, c in shares.items()]), "descr")


def sg_bars(table: DataFrame, base: float = 0.8, dynamic: bool = False) -> DataFrame:
    """descr, share_sg, share_complement, width_sg, width_complement of a result table: the bars of a chart."""
    width = 0.02 + base * F.col("relative_size_sg") if dynamic else F.lit(base / 2)
    return table.select("descr", F.col("target_share_sg").alias("share_sg"), F.col("target_share_complement").alias("share_complement"), width.alias("width_sg"), (base - width).alias("width_complement"))


def np_space(counts: DataFrame) -> DataFrame:
    """descr, negatives, positives: where each subgroup lies between the rows that hit and that miss."""
    return counts.select("descr", (F.col("n_sg") - F.col("pos_sg")).alias("negatives"), F.col("pos_sg").alias("positives"))


def roc_grid(spark: SparkSession, n: float, pos: float, a: float = 0.5, steps: int = 100) -> DataFrame:
    """fpr, tpr, quality over a grid from 0.01 to 0.99: the contours behind a ROC plot."""
    at = lambda c: (0.01 + F.col(c) * (0.98 / (steps - 1)))
    grid = spark.range(steps).select(F.col("id").alias("i")).crossJoin(spark.range(steps).select(F.col("id").alias("j"))).select(at("i").alias("fpr"), at("j").alias("tpr"))
    n_sg, pos_sg = F.col("fpr") * (n - pos) + F.col("tpr") * pos, F.col("tpr") * pos
    return grid.withColumn("quality", standard(a, F.lit(float(n)), F.lit(float(pos)), n_sg, pos_sg))


def histogram(values: DataFrame, column: str, group: str, bins: int, low: float, high: float) -> DataFrame:
    """group, bin, n: equal bins from low to high, ends included; other values and nulls are left out."""
    c = F.col(column).cast("double")
    at = F.least(F.floor((c - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return values.filter(c.between(low, high)).groupBy(group, at.alias("bin")).agg(F.count("*").alias("n"))


def block_histogram(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """block, label, n, p: members of each label in a block, and whether that is more or less than chance (exact two-sided test)."""
    joined = blocks.join(labels, "node")
    cells = joined.groupBy("block", "label").agg(F.count("*").alias("a"))
    rows = joined.groupBy("block").agg(F.count("*").alias("r"))
    columns = joined.groupBy("label").agg(F.count("*").alias("c"))
    total = joined.agg(F.count("*").alias("t"))
    # As many rows as blocks by labels.
    t = rows.crossJoin(columns).crossJoin(total).join(cells, ["block", "label"], "left").withColumn("a", F.coalesce("a", F.lit(0).cast("long")))
    t = t.select("block", "label", "a", (F.col("r") - F.col("a")).alias("b"), (F.col("c") - F.col("a")).alias("c"), (F.col("t") - F.col("r") - F.col("c") + F.col("a")).alias("d"))
    return fisher_two_sided(t).select("block", "label", F.col("a").alias("n"), "p")


def density_plot(density: DataFrame, sizes: DataFrame, least: int = 10, scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Nodes (block, size, width) of blocks of more than ``least`` members, and edges (bi, bj, density, width) between them."""
    large = sizes.filter(F.col("size") > least)
    ends = large.select("block")
    edges = density.join(ends.withColumnRenamed("block", "bi"), "bi", "left_semi").join(ends.withColumnRenamed("block", "bj"), "bj", "left_semi")
    return large.select("block", "size", (scale * F.sqrt("size") + 0.1).alias("width")), edges.select("bi", "bj", "density", (scale * F.col("density")).alias("width"))


def percent(c: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(100 * c, digits), F.lit("%"))


def set_bits(number: Column) -> Column:
    """Places of the bits that are set, the lowest first."""
    return F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: F.getbit(number, i) == 1)


def ordered_intersection(a: Column, b: Column) -> Column:
    """Common elements of two sorted arrays, in order."""
    return F.array_intersect(a, b)


def effective_sample_size(weight: Column) -> Column:
    """(sum of weights) squared over the sum of their squares."""
    return F.try_divide(F.pow(F.sum(weight), F.lit(2)), F.sum(weight * weight))


def outside(members: DataFrame, group: DataFrame) -> DataFrame:
    """Members that the group lacks."""
    return members.join(group.select("node"), "node", "left_anti")


#: Cells between the least and the largest value of a group, of which those of the median alone are ordered.
CELLS = 4096


def exact_medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, median of each group's finite values, for groups that have any: the mean of both middle ones where their number is even.

    No task holds the values of a group: counts of equal cells say where the middle is, and the values of those cells alone are ordered, equal ones as one.
    """
    x = F.col(value).cast("double")
    some = rows.select(F.col(key).alias("g"), x.alias("x")).filter(F.abs("x") < float("inf"))
    span = F.broadcast(some.groupBy("g").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n")))
    width = F.col("high") / CELLS - F.col("low") / CELLS
    cell = F.when(width > 0, F.least(F.floor(F.col("x") / width - F.col("low") / width), F.lit(CELLS - 1).cast("long"))).otherwise(F.lit(0).cast("long"))
    placed = some.join(span, "g").select("g", "n", "x", cell.alias("cell"))
    run = W.partitionBy("g").orderBy("cell")
    upto = placed.groupBy("g", "n", "cell").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(run))
    first, last = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)  # places of the middle ones, from 0
    middle = F.broadcast(upto.withColumn("before", F.col("upto") - F.col("c")).filter((F.col("before") <= last) & (F.col("upto") > first)).select("g", "cell", "before"))
    # Cells of a group that are neither its first nor its last middle one lie between both and hold none.
    values = placed.join(middle, ["g", "cell"]).groupBy("g", "n", "cell", "before", "x").agg(F.count("*").alias("c"))
    values = values.withColumn("upto", F.col("before") + F.sum("c").over(W.partitionBy("g", "cell").orderBy("x")))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("x")))
    return values.groupBy("g").agg((at(first) / 2 + at(last) / 2).alias("median")).withColumnRenamed("g", key)
