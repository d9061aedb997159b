"""Global summaries: a greedy recursive split of a graph into blocks that attributes describe.

One aggregate over the edges serves every cut of every block: from the counts of (inside, inside), (inside, all) and (all,
inside) the other pairs of a split follow by subtraction.  What a model expects of a pair of blocks follows from the classes of their
nodes: a histogram of (block, cut, class) and the table of class pairs.  Each split that could be made is a group of a few
such rows, which a task scores; of the scores the best alone is read.  Contents of pairs that a split leaves as they are are kept.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevein.operators.graph_stats import by_cover, held, merged
from lodevein.operators.model import Background, _cut
from lodevein.operators.prior import uniform_logit


def block_counts(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """bi, bj, k, n, density for every ordered pair of blocks, empty pairs too; blocks(node, block)."""
    sizes = blocks.groupBy("block").agg(F.count("*").alias("size"))
    k = (
        edges.join(blocks.select(F.col("node").alias("src"), F.col("block").alias("bi")), "src")
        .join(blocks.select(F.col("node").alias("dst"), F.col("block").alias("bj")), "dst")
        .groupBy("bi", "bj")
        .agg(F.count("*").alias("k"))
    )
    # As many rows as pairs of blocks, which the number of splits fixes.
    grid = sizes.select(F.col("block").alias("bi"), F.col("size").alias("ni")).crossJoin(F.broadcast(sizes.select(F.col("block").alias("bj"), F.col("size").alias("nj"))))
    n = F.when(F.col("bi") == F.col("bj"), F.col("ni") * (F.col("ni") - 1)).otherwise(F.col("ni") * F.col("nj"))
    out = grid.join(k, ["bi", "bj"], "left").select("bi", "bj", F.coalesce("k", F.lit(0)).cast("long").alias("k"), n.alias("n"))
    return out.withColumn("density", F.when(F.col("n") == 0, 0.0).otherwise(F.try_divide(F.col("k").cast("double"), F.col("n").cast("double"))))


def content(k: float, n: float, p: float) -> float:
    """n KL(k / n || p)."""
    if n <= 0:
        return 0.0
    out = 0.0
    if k > 0:
        out += k * math.log(k / (n * p))
    if n - k > 0:
        out += (n - k) * math.log((n - k) / (n * (1 - p)))
    return out


def split_counts(edges: DataFrame, blocks: DataFrame, support: DataFrame) -> DataFrame:
    """cut, bu, iu, bv, iv, k: edges by block of both ends and whether the cut holds them; support(cut, node).

    Counted for ends inside the cut alone; what is outside follows from the block counts.
    """
    ids = blocks.join(support.groupBy("node").agg(F.sort_array(F.collect_set("cut")).alias("cuts")), "node", "left")
    ids = ids.select("node", "block", F.coalesce("cuts", F.array().cast("array<int>")).alias("cuts"))
    e = edges.join(ids.select(F.col("node").alias("src"), F.col("block").alias("bu"), F.col("cuts").alias("cu")), "src")
    e = e.join(ids.select(F.col("node").alias("dst"), F.col("block").alias("bv"), F.col("cuts").alias("cv")), "dst")
    touched = e.select("bu", "bv", "cu", "cv", F.explode(F.array_union("cu", "cv")).alias("cut"))
    return touched.groupBy("cut", "bu", F.array_contains("cu", F.col("cut")).alias("iu"), "bv", F.array_contains("cv", F.col("cut")).alias("iv")).agg(F.count("*").alias("k"))


def content_under(k: float, rows: np.ndarray, columns: np.ndarray, same: bool, p: np.ndarray) -> float:
    """How much likelier ``k`` edges get from one block to another, or inside one, by the parameter that makes the model expect them.

    ``rows`` and ``columns`` count the blocks' nodes by class, ``p`` has the probabilities of class pairs; cells that can't hold an edge are left out.
    """
    r, c = np.flatnonzero(rows), np.flatnonzero(columns)
    times, q = np.outer(rows[r], columns[c]).astype(float), p[np.ix_(r, c)]
    if same:
        times -= np.diag(rows[r].astype(float))
    some = (times > 0) & (q > 0)
    times, q = times[some], q[some]
    total = times.sum()
    if not total:
        return 0.0
    if k <= 0:
        return float(-(times * np.log1p(-q)).sum())
    if k >= total:
        return float(-(times * np.log(q)).sum())
    odds = q / (1 - q)
    low, high, shift = -60.0, 60.0, 0.0
    for _ in range(200):  # Newton's steps, halved where they leave the bracket
        own = odds * math.exp(shift)
        now = own / (1 + own)
        off = float((times * now).sum() - k)
        low, high = (shift, high) if off < 0 else (low, shift)
        slope = float((times * now * (1 - now)).sum())
        step = shift - off / slope if slope else low
        step = step if low < step < high else (low + high) / 2
        if abs(step - shift) < 1e-13 * max(1.0, abs(shift)):
            break
        shift = step
    return float(k * shift - (times * np.log1p(q * math.expm1(shift))).sum())


def _flat(prior: float | Background, blocks: DataFrame) -> Background:
    """A density as a model of one class."""
    return prior if isinstance(prior, Background) else Background(np.array([[uniform_logit(prior)]]), blocks.select("node", F.lit(0).alias("class")))


def _histograms(blocks: DataFrame, model: Background) -> dict[int, np.ndarray]:
    """Nodes of each block by class: as many numbers as blocks, which the splits fix, times classes, which the model bounds."""
    out: dict[int, np.ndarray] = {}
    for r in blocks.join(merged(model.nodes), "node").groupBy("block", "class").agg(F.count("*").alias("n")).collect():
        out.setdefault(r["block"], np.zeros(len(model.logit), np.int64))[r["class"]] = r["n"]
    return out


def ends_of(edges: DataFrame, blocks: DataFrame, support: DataFrame, once: bool = False) -> DataFrame:
    """bu, cu, bv, cv, k: edges by the block and the cuts of both ends, in one pass; nodes of one block and the same cuts are one."""
    cuts = support.groupBy("node").agg(F.sort_array(F.collect_set("cut")).alias("ids"))
    named = blocks.join(merged(cuts), "node", "left").select("node", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"), "block")
    classes, between = by_cover(edges, named, "block", once=once, every=True)
    end = lambda c, b, i: classes.select(F.col("node").alias(c), F.col("block").alias(b), F.col("ids").alias(i))
    return between.join(end("src", "bu", "cu"), "src").join(end("dst", "bv", "cv"), "dst").select("bu", "cu", "bv", "cv", F.col("times").alias("k"))


def _blocks_between(ends: DataFrame) -> dict[tuple[int, int], int]:
    return {(r["bu"], r["bv"]): r["k"] for r in ends.groupBy("bu", "bv").agg(F.sum("k").alias("k")).collect()}


def split_scores(edges: DataFrame, blocks: DataFrame, support: DataFrame, model: Background, whole: dict[tuple[int, int], float], ends: DataFrame | None = None, once: bool = False) -> DataFrame:
    """block, cut, si, pairs of every split that parts a block; ``whole`` has the contents of the present pairs of blocks, ``ends`` what ``ends_of`` finds.

    ``pairs`` are the contents of the new ones: inside and outside of the cut with themselves and each other, then with each other block, in order.
    """
    ends = _cut(ends_of(edges, blocks, support, once)) if ends is None else ends
    base = defaultdict(int, _blocks_between(ends))
    size, p = _histograms(blocks, model), model.probabilities()
    names = sorted(size)
    c = len(names) + 1
    inner = blocks.join(merged(support), "node").join(merged(model.nodes), "node").groupBy("block", "cut", "class").agg(F.count("*").alias("n"))
    none = lambda kind: F.lit(None).cast(kind)
    held_by = inner.select("block", "cut", "class", "n", none("int").alias("bu"), none("boolean").alias("iu"), none("int").alias("bv"), none("boolean").alias("iv"))
    touched = ends.select("bu", "bv", "cu", "cv", "k", F.explode(F.array_union("cu", "cv")).alias("cut"))
    counts = touched.groupBy("cut", "bu", F.array_contains("cu", F.col("cut")).alias("iu"), "bv", F.array_contains("cv", F.col("cut")).alias("iv")).agg(F.sum("k").alias("k"))
    counts = counts.withColumn("block", F.explode(F.array_distinct(F.array("bu", "bv"))))
    counts = counts.select("block", "cut", none("int").alias("class"), F.col("k").alias("n"), "bu", "iu", "bv", "iv")

    def score(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        block, cut = rows[0]["block"], rows[0]["cut"]
        inside, k = np.zeros(len(p), np.int64), {}
        for r in rows:
            if r["class"] is not None:
                inside[r["class"]] = r["n"]
            else:
                k[r["bu"], r["iu"], r["bv"], r["iv"]] = r["n"]
        outside = size[block] - inside
        empty = {"block": pa.array([], pa.int32()), "cut": pa.array([], pa.int32()), "si": pa.array([], pa.float64()), "pairs": pa.array([], pa.list_(pa.float64()))}
        if not inside.any() or not outside.any():
            return pa.table(empty)
        k11, k10, k01 = (k.get((block, i, block, j), 0) for i, j in ((True, True), (True, False), (False, True)))
        k00 = base[block, block] - k11 - k10 - k01
        new = [content_under(k11, inside, inside, True, p), content_under(k10, inside, outside, False, p), content_under(k01, outside, inside, False, p), content_under(k00, outside, outside, True, p)]
        for other in names:
            if other != block:
                to = sum(k.get((block, True, other, j), 0) for j in (True, False))
                back = sum(k.get((other, j, block, True), 0) for j in (True, False))
                new += [content_under(to, inside, size[other], False, p), content_under(back, size[other], inside, False, p)]
                new += [content_under(base[block, other] - to, outside, size[other], False, p), content_under(base[other, block] - back, size[other], outside, False, p)]
        total = sum(v for pair, v in whole.items() if block not in pair) + sum(new)
        si = round(total / (c * (c + 1) / 2 + c + 50), 6)
        return pa.table([pa.array([block], pa.int32()), pa.array([cut], pa.int32()), pa.array([si]), pa.array([new], pa.list_(pa.float64()))], names=list(empty))

    return held_by.unionByName(counts).groupBy("block", "cut").applyInArrow(score, "block int, cut int, si double, pairs array<double>")


def _contents(ends: DataFrame, blocks: DataFrame, model: Background) -> dict[tuple[int, int], float]:
    size, p, k = _histograms(blocks, model), model.probabilities(), _blocks_between(ends)
    return {(i, j): content_under(k.get((i, j), 0), size[i], size[j], i == j, p) for i in size for j in size}


def best_split(edges: DataFrame, blocks: DataFrame, support: DataFrame, prior: float | Background) -> tuple | None:
    """(si, cut, block) of the best split of any block by any cut under a density or a model; the first in order of block and cut among equals."""
    model = _flat(prior, blocks)
    ends = _cut(ends_of(edges, blocks, support))
    best = split_scores(edges, blocks, support, model, _contents(ends, blocks, model), ends).orderBy(F.desc("si"), "block", "cut").first()
    return None if best is None else (best["si"], best["cut"], best["block"])


def summarize(nodes: DataFrame, edges: DataFrame, support: DataFrame, prior: float | Background, rounds: int = 3, once: bool = False) -> tuple[DataFrame, list[tuple]]:
    """blocks(node, block) after ``rounds`` splits, and a row (round, si, cut, block) for each; stops where no cut splits.

    ``prior`` is a density or a model; each pair of blocks gets the parameter that makes the model expect its edges, anew after each split.
    Edges are read once: blocks are unions of nodes of the same cuts, so their counts by cuts serve all rounds.
    """
    blocks = nodes.select(F.col("node_id").alias("node"), F.lit(0).alias("block"))
    model, done = _flat(prior, blocks), []
    with held(support, model.nodes):
        ends = _cut(ends_of(edges, blocks, support, once))
        whole = _contents(ends, blocks, model)
        for i in range(rounds):
            best = split_scores(edges, blocks, support, model, whole, ends).orderBy(F.desc("si"), "block", "cut").first()
            if best is None:
                break
            cut, block, new = best["cut"], best["block"], i + 1
            others = sorted({a for a, _ in whole} - {block})
            pairs = [(block, block), (block, new), (new, block), (new, new)]
            for other in others:
                pairs += [(block, other), (other, block), (new, other), (other, new)]
            whole |= dict(zip(pairs, best["pairs"], strict=True))
            inside = support.filter(F.col("cut") == cut).select("node", F.lit(True).alias("inside"))
            number = F.when((F.col("block") == block) & F.col("inside").isNull(), F.lit(new)).otherwise(F.col("block"))
            blocks = _cut(blocks.join(merged(inside), "node", "left").select("node", number.alias("block")))
            moved = lambda b, c: F.when((F.col(b) == block) & ~F.array_contains(c, cut), F.lit(new)).otherwise(F.col(b)).alias(b)
            ends = ends.select(moved("bu", "cu"), "cu", moved("bv", "cv"), "cv", "k")
            done.append((new, best["si"], cut, block))
    return blocks, done
