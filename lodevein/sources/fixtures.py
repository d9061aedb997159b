"""Attributed graphs and relations derived from the business tables, and small literal graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodevein.operators.graph_stats import symmetric


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node_id"), "p_brand", "p_type", "p_size", "p_retailprice")


#: Lines of orders that one task pairs: tasks grow in number with the table, and not in size.
LINES = 300_000


def pair_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks that make pairs of parts, or take these on."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // LINES))


def copurchase_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two parts in one order, src < dst.  An order has a few lines, so the self-join grows with the table; lines move once, for all that follows."""
    parts = pair_tasks(spark, sf_dir)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").repartition(parts, "l_orderkey").distinct()
    other = lines.withColumnsRenamed({"l_partkey": "dst"})
    return lines.join(other, "l_orderkey").filter("l_partkey < dst").select(F.col("l_partkey").alias("src"), "dst").repartition(parts, "src", "dst").distinct()


def copurchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected: each pair of ``copurchase_once`` in both directions."""
    return mirrored(copurchase_once(spark, sf_dir))


def mirrored(once: DataFrame) -> DataFrame:
    """Pairs in both directions, made where the pair is."""
    ends = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    return once.select(F.inline(F.array(ends("src", "dst"), ends("dst", "src"))))


def successions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed, weighted: from the user of an event to the user of the next one within the same hour of the log."""
    order = W.partitionBy(F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    steps = table(spark, sf_dir, "events").select(F.col("user_id").alias("src"), F.lead("user_id").over(order).alias("dst"))
    return steps.filter("dst is not null and src != dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with their most frequent event type (ties by name)."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return counts.groupBy(F.col("user_id").alias("node_id")).agg(F.min_by("event_type", F.struct((-F.col("n")).alias("n"), "event_type")).alias("event_type"))


def customer_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangular incidence (row_id, col_id)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("row_id"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("col_id"))
    return o.join(lines, "o_orderkey").select("row_id", "col_id").distinct()


#: The small graphs, as (source, target) pairs and rows of binary attributes.
SIX_NODES = [(0, 1), (0, 2), (2, 3), (2, 4), (2, 5), (3, 1)]
STAR = [(0, 1), (0, 2), (0, 3), (0, 4), (0, 5)]


#: Three small graphs in compressed rows (where each row begins, columns), and their binary attributes by node.
OLD_ROWS, OLD_COLUMNS = [0, 4, 7, 9, 11, 12, 13, 16, 18, 19, 19], [1, 2, 3, 6, 2, 3, 4, 3, 5, 4, 5, 5, 8, 7, 8, 9, 8, 9, 9]
OLD_ATTRIBUTES = {"a": [1, 0, 1, 0, 1, 0, 0, 1, 0, 0], "b": [0, 0, 1, 0, 0, 1, 1, 1, 1, 1], "c": [1, 1, 0, 1, 0, 1, 0, 0, 0, 0], "d": [0, 0, 0, 0, 1, 0, 0, 0, 1, 0], "e": [0, 1, 0, 0, 0, 0, 1, 1, 1, 1]}
NEW_ROWS, NEW_COLUMNS = [0, 4, 6, 8, 8, 10, 11, 14, 16, 18, 18, 18], [1, 2, 3, 4, 2, 3, 3, 9, 5, 7, 6, 8, 9, 10, 8, 10, 9, 10]
NEW_ATTRIBUTES = {"a": [0, 0, 0, 0, 1, 0, 0, 1, 0, 1, 1], "b": [1, 1, 1, 1, 1, 0, 0, 1, 0, 0, 0], "c": [0, 0, 1, 0, 0, 0, 1, 1, 1, 1, 1], "d": [1, 0, 1, 1, 1, 0, 0, 0, 0, 1, 0]}
TWO_SIDED = {0: [1, 2], 1: [0, 2], 2: [0, 1], 3: [6, 7, 8, 9], 4: [6, 7, 8, 9], 5: [6, 7, 8, 9], 6: [0, 1], 7: [0, 2], 8: [1, 2], 9: [2]}
TWO_SIDED_ATTRIBUTES = {"a": [0, 0, 0, 1, 1, 1, 1, 1, 0, 0], "b": [1, 1, 1, 0, 0, 0, 1, 1, 0, 1], "c": [0, 1, 0, 0, 1, 0, 1, 1, 1, 1], "d": [1, 1, 0, 1, 1, 0, 0, 0, 0, 0]}


def _attributes(spark: SparkSession, columns: dict[str, list[int]]) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(zip(*columns.values(), strict=True))]
    return spark.createDataFrame(rows, "node_id long, " + ", ".join(f"{c} int" for c in columns))


def _compressed(starts: list[int], columns: list[int]) -> list[tuple[int, int]]:
    return [(i, c) for i in range(len(starts) - 1) for c in columns[starts[i] : starts[i + 1]]]


def old_synthetic(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Ten nodes, undirected: nodes with five binary attributes, and edges."""
    return _attributes(spark, OLD_ATTRIBUTES), literal(spark, _compressed(OLD_ROWS, OLD_COLUMNS), undirected=True)


def new_synthetic(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Eleven nodes, undirected, four attributes."""
    return _attributes(spark, NEW_ATTRIBUTES), literal(spark, _compressed(NEW_ROWS, NEW_COLUMNS), undirected=True)


def two_sided_synthetic(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Ten nodes, directed, with a dense pair of groups; four attributes."""
    return _attributes(spark, TWO_SIDED_ATTRIBUTES), literal(spark, [(a, b) for a, bs in TWO_SIDED.items() for b in bs])


def literal(spark: SparkSession, pairs: list[tuple[int, int]], undirected: bool = False) -> DataFrame:
    edges = spark.createDataFrame(pairs, "src long, dst long")
    return symmetric(edges) if undirected else edges
