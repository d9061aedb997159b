"""Iterated mining: find the most surprising pattern, store it in the model, search again; and its summaries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodevein.functions.selectors import Selector, cover, covers_all
from lodevein.operators.graph_stats import held, totals
from lodevein.operators.model import Background, _cut
from lodevein.plans.search import Task, beam_graph, beam_pairs, si_model


def mine(nodes: DataFrame, edges: DataFrame, task: Task, model: Background, rounds: int = 5, key: str = "node_id", once: bool = False) -> tuple[DataFrame, Background]:
    """round, descr, n, k, expected, quality, lambda of the best pattern of each round, and the last model; stops where nothing surprises."""
    spark = nodes.sparkSession
    by_text = {s.descr: s for s in task.selectors}
    found = []
    with held(edges):
        n, m = totals(nodes, edges, once)
        for i in range(rounds):
            best = beam_graph(nodes, edges, task, si_model, n, m, model=model, once=once).orderBy("rank").limit(1).collect()
            if not best:
                break
            b = best[0]
            members = nodes.filter(covers_all([by_text[x] for x in b["descr"].split(" AND ")])).select(F.col(key).alias("node"))
            model, shift, before, _ = model.pattern(members, None, b["k"])
            model.nodes = _cut(model.nodes)
            found.append((i + 1, b["descr"], b["n"], b["k"], before, b["quality"], shift))
    return spark.createDataFrame(found, "round int, descr string, n long, k long, expected double, quality double, lambda double"), model


def mine_pairs(nodes: DataFrame, edges: DataFrame, task: Task, model: Background, rounds: int = 3, outer: int = 8, constrained: bool = False, key: str = "node_id", once: bool = False) -> tuple[DataFrame, Background]:
    """round, descr, descr2, n, k, expected, quality, lambda of the best pair of subgroups of each round, and the last model; stops where nothing surprises.

    A pair that is stored splits the classes of nodes by membership on both sides, so the next round's beams count on what the model believes by then.
    """
    spark = nodes.sparkSession
    by_text = {s.descr: s for s in task.selectors}
    members = lambda descr: nodes.filter(covers_all([by_text[x] for x in descr.split(" AND ")])).select(F.col(key).alias("node"))
    found = []
    with held(edges):
        n, m = totals(nodes, edges, once)
        for i in range(rounds):
            best = beam_pairs(nodes, edges, task, n, m, outer=outer, constrained=constrained, model=model, once=once).orderBy("rank").limit(1).collect()
            if not best:
                break
            b = best[0]
            model, shift, before, _ = model.pattern(members(b["descr"]), members(b["descr2"]), b["k"])
            model.nodes = _cut(model.nodes)
            found.append((i + 1, b["descr"], b["descr2"], b["n"], b["k"], before, b["quality"], shift))
    return spark.createDataFrame(found, "round int, descr string, descr2 string, n long, k long, expected double, quality double, lambda double"), model


def block_contents(edges: DataFrame, blocks: DataFrame, model: Background) -> DataFrame:
    """bi, bj, k, n, expected, lambda, ic for every ordered pair of blocks(node, block): the parameter that a pair would get, and its information content."""
    from lodevein.plans.summarize import block_counts

    spark = edges.sparkSession
    out = []
    for r in sorted(block_counts(edges, blocks).collect()):  # a row for each pair of blocks, which the splits fix
        side = lambda b: blocks.filter(F.col("block") == b).select("node")
        same = r["bi"] == r["bj"]
        one = replace(model, undirected=False)  # a pair of blocks holds in its own orientation
        _, shift, before, gain = one.pattern(side(r["bi"]), None if same else side(r["bj"]), r["k"])
        out.append((r["bi"], r["bj"], r["k"], r["n"], before, shift, gain))
    kind = dict(blocks.dtypes)["block"]
    return spark.createDataFrame(out, f"bi {kind}, bj {kind}, k long, n long, expected double, lambda double, ic double")


def replay(nodes: DataFrame, selectors: list[Selector], summary: list[tuple[int, int]], order: str | None = None, key: str = "node_id") -> tuple[DataFrame, DataFrame]:
    """Blocks of a summary, a list of (cut, block index) splits: what each block is, and its members in order.

    A split puts what the cut holds before the rest.  Returns (block, descr, size, upto), upto the position of the block's end, and
    (node, block, place), places by ``order`` within a block.
    """
    spark = nodes.sparkSession
    groups = cover(nodes, key, selectors)
    at = F.col("block")
    members = groups.select("node", "ids", F.lit(0).alias("block"))
    text: list[list[str]] = [[]]
    for cut, index in summary:
        inside = F.array_contains("ids", F.lit(cut))
        members = members.withColumn("block", F.when((at > index) | ((at == index) & ~inside), at + 1).otherwise(at))
        here = text[index]
        text[index : index + 1] = [[*here, selectors[cut].descr], [*here, f"NOT {selectors[cut].descr}"]]
    names = spark.createDataFrame([(i, " AND ".join(t) or "Dataset") for i, t in enumerate(text)], "block int, descr string")
    sizes = members.groupBy("block").agg(F.count("*").alias("size"))
    blocks = names.join(sizes, "block", "left").withColumn("size", F.coalesce("size", F.lit(0).cast("long")))
    # A row for each block.
    blocks = blocks.withColumn("upto", F.sum("size").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, 0)))
    if order:
        members = members.join(nodes.select(F.col(key).alias("node"), F.col(order).alias("by")), "node")
    else:
        members = members.withColumn("by", F.lit(0))
    placed = members.withColumn("place", F.row_number().over(W.partitionBy("block").orderBy("by", "node")))
    return blocks, placed.select("node", "block", "place")
