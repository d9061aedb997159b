"""Embedding near-dedup by cross-polytope hashing.

Vectors that are equal component by component become one class.  Each class is rotated by three rounds of random
signs and a fast Hadamard transform, and a hash is the nearest corner of the cross-polytope: the largest
coordinate and its sign.  A table joins ``hashes`` of them.  A vector is stored in its own bucket of every table and
also probes the buckets that its next-best corners give.  Within a bucket cosines are computed in double precision,
in blocks; pairs at or over the threshold are links.

A pair that meets in several buckets counts in the first alone: every vector carries all its codes, so a bucket
can tell.  A bucket thus returns, for each vector, its number of links and one vector that it hangs together with,
never the pairs; large buckets are dealt out as pairs of chunks.

A table that joins more hashes for a larger corpus finds less pairs; so many tables are taken that a pair at the threshold is
found with probability ``RECALL``, which is measured for the dimension and the number of hashes.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, have
themselves as component and are kept; vectors of different lengths don't link; a null id has no links, a null component
and isn't kept; rows that repeat an id are vectors of their own with that id; equal cosines need no order, as every link counts; vectors of
any length are read whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevein.llm.common import settle
from lodevein.llm.graph import components

THRESHOLD = 0.9
#: Tables at least; and the share of pairs at the threshold that some table joins.
TABLES = 8
RECALL = 0.995
PROBES = 3
CHUNK = 2048
STRIP = 256
SEED = 7


def hashes_for(n: int, dim: int) -> int:
    """Corners that a table joins: so many that a bucket of unrelated vectors stays within a few hundred."""
    corners = 2 * padded(dim)
    k = 1
    while n / corners**k > 512:
        k += 1
    return k


def tables_for(dim: int, hashes: int, threshold: float, probes: int = PROBES) -> int:
    """Tables of which one at least joins a pair at the threshold with probability RECALL, TABLES at least.

    The share of pairs that one table joins is measured on random pairs of exactly that cosine.
    """
    rng = np.random.default_rng(SEED + 1)
    x, n = rng.normal(size=(2, 1024, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n -= (n * x).sum(1, keepdims=True) * x
    n /= np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-12)
    y = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * n
    a, b = (codes(v, 2, hashes, probes, SEED + 1) for v in (x, y))
    met = np.mean([_met(a[:, t], b[:, t]) < np.iinfo(np.int64).max for t in range(2)])
    if met >= 1:
        return TABLES
    return max(TABLES, int(np.ceil(np.log(1 - RECALL) / np.log(1 - max(met, 1e-3)))))


def padded(dim: int) -> int:
    return 1 << max(1, (dim - 1).bit_length())


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2)
        h *= 2
    return x.reshape(n, d) / np.sqrt(d)


def codes(x: np.ndarray, tables: int = TABLES, hashes: int = 1, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """n x tables x (1 + probes) bucket numbers, each vector's own bucket first."""
    n, dim = x.shape
    d = padded(dim)
    wide = np.zeros((n, d), np.float64)
    wide[:, :dim] = x
    rng = np.random.default_rng(seed)
    out = np.full((n, tables, 1 + probes), -1)  # short vectors have fewer corners to probe
    for t in range(tables):
        own = np.zeros(n, np.int64)
        losses, deltas = [], []
        for _ in range(hashes):
            y = wide
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], d))
            size = np.abs(y)
            best = np.argpartition(-size, min(probes, d - 1), axis=1)[:, : probes + 1]
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(size, best, 1), axis=1, kind="stable"), 1)
            corner = 2 * best + (np.take_along_axis(y, best, 1) < 0)
            top = np.take_along_axis(size, best, 1)
            losses.append(top[:, :1] - top[:, 1:])
            deltas.append(corner)
            own = own * (2 * d) + corner[:, 0]
        out[:, t, 0] = own
        # Probes replace one corner by a worse one; the least losses over all hashes come first.
        loss = np.concatenate(losses, axis=1)
        change = np.concatenate([(c[:, 1:] - c[:, :1]) * (2 * d) ** (hashes - 1 - i) for i, c in enumerate(deltas)], axis=1)
        order = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        out[:, t, 1 : 1 + order.shape[1]] = own[:, None] + np.take_along_axis(change, order, 1)
    return out


def _met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least bucket that pairs of code rows (m x (1 + probes)) meet in, or a value over all buckets."""
    none = np.iinfo(np.int64).max
    at_a = np.where((b == a[:, :1]).any(1), a[:, 0], none)
    at_b = np.where((a == b[:, :1]).any(1), b[:, 0], none)
    return np.minimum(at_a, at_b)


def _roots(n: int, i: np.ndarray, j: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Merge pairs into a forest in which each node points at a smaller one or itself."""
    while len(i):
        lo, hi = np.minimum(up[i], up[j]), np.maximum(up[i], up[j])
        open_ = lo != hi
        if not open_.any():
            break
        i, j, lo, hi = i[open_], j[open_], lo[open_], hi[open_]
        np.minimum.at(up, hi, lo)
        while not np.array_equal(up, up[up]):
            up = up[up]
    return up


def link_block(table: int, code: int, ids: np.ndarray, x: np.ndarray, own: np.ndarray, weight: np.ndarray, all_codes: np.ndarray, chunk: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Weighted links of each member that this bucket owns, and its root (a row of the block)."""
    n = len(ids)
    counts, up = np.zeros(n, np.int64), np.arange(n)
    two = chunk.min() != chunk.max()
    for s in range(0, n, STRIP):
        e = min(n, s + STRIP)
        hit = x[s:e] @ x[s:].T >= threshold  # only with rows from here on: each pair once
        hit &= own[s:e, None] | own[None, s:]
        if two:
            hit &= chunk[s:e, None] != chunk[None, s:]
        i, j = np.nonzero(hit)
        i, j = i + s, j + s
        keep = i < j
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        up = _roots(n, i, j, up)
        mine = _met(all_codes[i, table], all_codes[j, table]) == code
        for t in range(table):
            mine &= _met(all_codes[i, t], all_codes[j, t]) == np.iinfo(np.int64).max
        np.add.at(counts, i[mine], weight[j[mine]])
        np.add.at(counts, j[mine], weight[i[mine]])
    return counts, up


def classes(vectors: DataFrame) -> DataFrame:
    """vec_id, key: key stands for the vector, or is null where it can't link."""
    e = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & e.isNotNull() & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(e, lambda v: v != 0)
    key = F.unhex(F.sha2(F.array_join(F.transform(e, lambda v: v.cast("string")), ","), 256))
    return vectors.select("vec_id", F.when(F.coalesce(fine, F.lit(False)), key).alias("key"), "embedding")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tables: int | None = None, probes: int = PROBES) -> DataFrame:
    """vec_id, n_links, component_id, kept for every vector."""
    keyed = classes(vectors)
    member = settle(keyed.select("vec_id", "key"))
    groups = member.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    groups = settle(groups)
    one = keyed.filter("key is not null").join(groups, "key").filter(F.col("vec_id") == F.col("rep")).dropDuplicates(["key"])
    reps = settle(one.select("rep", "copies", F.col("embedding").cast("array<double>").alias("x"), F.size("embedding").alias("dim")))
    # Each length of vectors has hashes and tables of its own, from its number of vectors.
    plan = {}
    for r in reps.groupBy("dim").count().collect():
        k = hashes_for(r["count"], r["dim"])
        plan[r["dim"]] = k, tables or tables_for(r["dim"], k, threshold, probes)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                x = part.column("x").flatten().to_numpy().reshape(-1, dim)
                x = x / np.abs(x).max(1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                k, own = plan[int(dim)]
                c = codes(x, own, k, probes)
                flat = lambda a, kind: pa.array(list(a.reshape(len(a), -1)), pa.list_(kind))
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("copies"), part.column("dim"), flat(x, pa.float64()), flat(c, pa.int64())], ["rep", "copies", "dim", "x", "codes"])

    coded = settle(reps.mapInArrow(hashed, "rep long, copies long, dim int, x array<double>, codes array<long>"))
    width = 1 + probes
    entry = F.explode(F.transform(F.sequence(F.lit(0), F.size("codes") - 1), lambda i: F.struct((i / width).cast("int").alias("t"), (i % width == 0).alias("own"), F.element_at("codes", i + 1).alias("code"))))
    at = coded.select("rep", "dim", entry.alias("e")).select("rep", "dim", "e.*")
    # Buckets of one member, and buckets that are only probed, hold no pair.
    sizes = at.groupBy("dim", "t", "code").agg(F.count("*").alias("n"), F.max("own").alias("any_own")).filter("n > 1 and any_own")
    sizes = settle(sizes.select("dim", "t", "code", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")))
    full = coded.select("*", entry.alias("e")).select("rep", "copies", "dim", "x", "codes", "e.*")
    placed = full.join(sizes, ["dim", "t", "code"]).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks").cast("long")).cast("int"))
    # Chunk c meets every chunk: block (min, max) of the two numbers.
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    placed = placed.withColumn("lo", F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other")).drop("other", "chunks")

    def block(group: pa.Table) -> pa.Table:
        first = group.slice(0, 1).to_pylist()[0]
        n, dim = len(group), first["dim"]
        matrix = lambda c, w: group.column(c).combine_chunks().flatten().to_numpy().reshape(n, w)
        ids = group.column("rep").to_numpy()
        order = np.argsort(ids, kind="stable")  # so that roots are the smallest ids
        counts, up = link_block(
            first["t"], first["code"], ids[order], matrix("x", dim)[order], group.column("own").to_numpy()[order], group.column("copies").to_numpy()[order],
            matrix("codes", plan[dim][1] * width).reshape(n, plan[dim][1], width)[order], group.column("chunk").to_numpy()[order], threshold,
        )
        ids = ids[order]
        some = (counts > 0) | (up != np.arange(n))
        return pa.table({"a": ids[some], "b": ids[up[some]], "n": counts[some]})

    found = settle(placed.groupBy("dim", "t", "code", "lo", "hi").applyInArrow(block, "a long, b long, n long"))
    linked = components(found.select("a", "b"))
    totals = found.groupBy("a").agg(F.sum("n").alias("n"))
    of_class = groups.join(totals, groups["rep"] == totals["a"], "left").join(linked, groups["rep"] == linked["node"], "left")
    of_class = of_class.select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    return member.join(of_class, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(False)).alias("kept")
    )


#: All pairs by brute force, for small tables in DuckDB.
PAIRS_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0)
SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.r <> b.r AND list_cosine_similarity(a.x, b.x) >= 0.9
"""
