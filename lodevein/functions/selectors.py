"""Selectors (conditions on attributes), their text, and how they are generated from a table."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _number(x: float) -> str:
    """At most two digits behind the point, none for whole numbers."""
    return str(int(x)) if float(x).is_integer() else str(round(x, 2))


@dataclass(frozen=True)
class Nominal:
    """attribute = value; null and NaN match nothing."""

    attribute: str
    value: object

    @property
    def descr(self) -> str:
        return f"{self.attribute}={self.value}"

    def covers(self) -> Column:
        c = F.col(self.attribute)
        hit = c == F.lit(self.value)
        return F.coalesce(hit & ~F.isnan(c) if isinstance(self.value, float) else hit, F.lit(False))


@dataclass(frozen=True)
class Interval:
    """lower <= attribute < upper; an infinite bound is left out, but infinity itself isn't less than it."""

    attribute: str
    lower: float
    upper: float

    @property
    def descr(self) -> str:
        if self.lower == -math.inf and self.upper == math.inf:
            return f"{self.attribute}= anything"
        if self.lower == -math.inf:
            return f"{self.attribute}<{_number(self.upper)}"
        if self.upper == math.inf:
            return f"{self.attribute}>={_number(self.lower)}"
        return f"{self.attribute}: [{_number(self.lower)}:{_number(self.upper)}]"

    def covers(self) -> Column:
        c = F.col(self.attribute).cast("double")
        hit = ~F.isnan(c) & (c < F.lit(self.upper))
        if self.lower != -math.inf:
            hit &= c >= F.lit(self.lower)
        return F.coalesce(hit, F.lit(False))


@dataclass(frozen=True)
class Negated:
    """Rows that the other selector doesn't cover."""

    other: Nominal | Interval

    @property
    def attribute(self) -> str:
        return self.other.attribute

    @property
    def descr(self) -> str:
        return f"NOT {self.other.descr}"

    def covers(self) -> Column:
        return ~self.other.covers()


Selector = Nominal | Interval | Negated


def describe(selectors: list[Selector]) -> str:
    return " AND ".join(sorted(s.descr for s in selectors)) or "Dataset"


def covers_all(selectors: list[Selector]) -> Column:
    """A conjunction; the empty one covers every row."""
    out = F.lit(True)
    for s in selectors:
        out &= s.covers()
    return out


def is_numeric(df: DataFrame, attribute: str) -> bool:
    return isinstance(df.schema[attribute].dataType, T.NumericType)


@contextmanager
def histogram(df: DataFrame, attribute: str, weight: str | None = None) -> Iterator[DataFrame]:
    """v, n, upto: distinct values with their (weighted) count and running sum, without a single-task sort; cached for the caller's jobs.

    Values are range-partitioned; sums of the partitions (few) give each its offset.
    """
    c = F.col(attribute)
    rows = df.filter(c.isNotNull() & ~F.isnan(c.cast("double")))
    n = F.sum(F.col(weight).cast("double")) if weight else F.count("*").cast("double")
    ranged = rows.groupBy(c.alias("v")).agg(n.alias("n")).repartitionByRange("v").withColumn("part", F.spark_partition_id()).persist()
    sums = {r["part"]: r["s"] for r in ranged.groupBy("part").agg(F.sum("n").alias("s")).collect()}
    before, run = {}, 0.0
    for p in sorted(sums):
        before[p] = run
        run += sums[p]
    offset = F.create_map(*[x for p, s in before.items() for x in (F.lit(p), F.lit(s))])[F.col("part")] if before else F.lit(0.0)
    window = W.partitionBy("part").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    try:
        yield ranged.withColumn("upto", F.sum("n").over(window) + offset).select("v", "n", "upto")
    finally:
        ranged.unpersist()


def equal_frequency_cuts(df: DataFrame, attribute: str, nbins: int = 5) -> list:
    """Value at position i n / nbins of the sorted column for every i; a value used before gives way to the next one."""
    with histogram(df, attribute) as h:
        total = int(h.agg(F.sum("n")).first()[0] or 0)
        places = [i * total // nbins for i in range(1, nbins)] if total else []
        if not places:
            return []
        at = h.agg(*[F.min(F.when(F.col("upto") > p, F.col("v"))).alias(f"c{i}") for i, p in enumerate(places)]).first()
        cuts: list = []
        for v in at:
            if cuts and v <= cuts[-1]:
                v = h.filter(F.col("v") > cuts[-1]).agg(F.min("v")).first()[0]
            if v is not None:
                cuts.append(v)
        return cuts


def weighted_cuts(df: DataFrame, attribute: str, weight: str, nbins: int = 5) -> list:
    """Cuts where the running weight since the last cut exceeds a bin's share; the last bin keeps under 1.5 shares."""
    with histogram(df, attribute, weight) as h:
        total = float(h.agg(F.sum("n")).first()[0] or 0.0)
        share, cuts, spent = total / nbins, [], 0.0
        while True:
            row = h.filter(F.col("upto") - F.lit(spent) > share).agg(F.min_by(F.struct("v", "upto"), "v").alias("r")).first()["r"]
            if row is None:
                return cuts
            cuts.append(row["v"])
            spent = row["upto"]
            if total - spent < 1.5 * share:
                return cuts


def frequency_cuts(df: DataFrame, attribute: str, n_bins: int = 4) -> list:
    """As ``equal_frequency_cuts``, but repeated values stay."""
    with histogram(df, attribute) as h:
        total = int(h.agg(F.sum("n")).first()[0] or 0)
        if not total:
            return []
        return list(h.agg(*[F.min(F.when(F.col("upto") > int(total / n_bins * i), F.col("v"))).alias(f"c{i}") for i in range(1, n_bins)]).first())


def nominal_selectors(df: DataFrame, attribute: str, order: str | None = None) -> list[Selector]:
    """One selector for each value, by first appearance if there is a column of order, else by value."""
    by = F.min(order) if order else F.min(attribute)
    rows = df.filter(F.col(attribute).isNotNull()).groupBy(attribute).agg(by.alias("__o")).orderBy("__o", attribute).collect()
    return [Nominal(attribute, r[attribute]) for r in rows]


def numeric_selectors(df: DataFrame, attribute: str, nbins: int = 5, intervals_only: bool = True) -> list[Selector]:
    """Equality for at most ``nbins`` values, else disjoint intervals between cuts, or both sides of every cut."""
    few = [r[0] for r in df.select(attribute).filter(F.col(attribute).isNotNull()).distinct().limit(nbins + 1).collect()]
    if len(few) <= nbins:
        return [Nominal(attribute, v) for v in sorted(few)]
    cuts = equal_frequency_cuts(df, attribute, nbins)
    if not intervals_only:
        return [s for c in cuts for s in (Interval(attribute, -math.inf, c), Interval(attribute, c, math.inf))]
    ends = [-math.inf, *cuts, math.inf]
    return [Interval(attribute, a, b) for a, b in zip(ends, ends[1:], strict=False)]


def create_selectors(df: DataFrame, nbins: int = 5, intervals_only: bool = True, ignore: tuple[str, ...] = (), order: str | None = None) -> list[Selector]:
    """Nominal attributes first, then numeric ones, in column order."""
    names = [c for c in df.columns if c not in ignore]
    out = [s for c in names if not is_numeric(df, c) for s in nominal_selectors(df, c, order)]
    return out + [s for c in names if is_numeric(df, c) for s in numeric_selectors(df, c, nbins, intervals_only)]


def without_attributes(selectors: list[Selector], attributes: tuple[str, ...]) -> list[Selector]:
    """Selectors on other attributes, as for a target column."""
    return [s for s in selectors if s.attribute not in attributes]


def cover(df: DataFrame, key: str, selectors: list[Selector]) -> DataFrame:
    """key, ids: the numbers of all selectors that cover a row, in one pass over the table."""
    hits = F.array(*[F.when(s.covers(), F.lit(i)) for i, s in enumerate(selectors)])
    return df.select(F.col(key).alias("node"), F.array_compact(hits).alias("ids"))


def selector_table(spark, selectors: list[Selector]) -> DataFrame:
    """sg, descr, attribute."""
    return spark.createDataFrame([(i, s.descr, s.attribute) for i, s in enumerate(selectors)], "sg int, descr string, attribute string")
