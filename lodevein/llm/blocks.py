"""Document frequencies of 64-bit tokens, exact and over the whole corpus, through packed arrays.

Texts are packed into blocks of a few megabytes.  Each block sends its distinct tokens to buckets as arrays of 32-bit
remainders (the bucket number holds the first bits of a token), with the number of its documents that hold them.  A bucket
sums them over all blocks and sends back, in the same order, a code for each token: 0 where a single document
holds it, else 1 + twice the binary logarithm of the number.  A token that every document holds is one entry for each block.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevein.llm.common import settle

BLOCK_BYTES = 2 << 20
#: Bytes of text whose tokens meet in a bucket, about; the number of buckets grows with the corpus.
BUCKET_BYTES = 32 << 20
LEAST_BITS, MOST_BITS = 8, 19
#: Tokens of a row to a bucket, about, and those of all rows of blocks that go together, at most.
ROW_TOKENS, MOST_TOKENS = 32, 1 << 24

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def distinct_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of equal texts (a null text is empty): member(doc_id, key), classes(key, rep), once(key, doc_id, text).

    ``rep`` is the smallest id of a class, null where all are null; ``key`` is the text's whole sha-256; ``once``
    holds a row of each class with its ``rep``.
    """
    key = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), "text")
    member = settle(keyed.select("doc_id", "key"))
    classes = settle(member.groupBy("key").agg(F.min("doc_id").alias("rep")))
    # The first id of a class stays.  Ids that go are few, so the texts needn't move where the optimizer can broadcast
    # them.  An id of several rows, or none, doesn't tell them apart; there the key decides.
    known = member.filter("doc_id is not null")
    several = settle(known.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    gone = settle(known.join(classes, "key").filter(F.col("doc_id") > F.col("rep")).select("doc_id").union(several).distinct())
    named = keyed.filter("doc_id is not null")
    once = named.join(gone, "doc_id", "left_anti")
    unclear = named.join(several, "doc_id", "left_semi").unionByName(keyed.filter("doc_id is null"))
    unclear = unclear.join(classes, "key").filter(F.col("doc_id").eqNullSafe(F.col("rep"))).dropDuplicates(["key"]).select(once.columns)
    return member, classes, once.union(unclear).select("key", "doc_id", "text")


#: A text's number is its task's times this and its place in the task.
TASK_TEXTS = 1 << 36


def pack(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, numbers, ids, keys, ends, data: texts of docs(key, doc_id, text) in blocks, and a number of its own for each; a null text is empty.

    ``ends`` says where texts end, ``data`` are their bytes, compressed.  Written, so that blocks and numbers stay as they are.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, seen = TaskContext.get().partitionId(), 0, 0
        ids, keys, texts, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            numbers = part * TASK_TEXTS + seen + np.arange(len(ids))
            return block_row(f"{part}-{made}", numbers, ids, keys, np.cumsum([len(t) for t in texts], dtype=np.int64), b"".join(texts))

        for b in batches:
            for k, i, t in zip(*(b.column(c).to_pylist() for c in ("key", "doc_id")), b.column("text").cast(pa.binary()), strict=True):
                t = t.as_py() or b""
                if ids and size + len(t) > block_bytes:
                    yield block()
                    seen, made = seen + len(ids), made + 1
                    ids, keys, texts, size = [], [], [], 0
                ids.append(i)
                keys.append(k)
                texts.append(t)
                size += len(t)
        if ids:
            yield block()

    return settle(docs.select("key", "doc_id", "text").mapInArrow(packed, BLOCK))


BLOCK = "block string, numbers array<long>, ids array<long>, keys array<binary>, ends array<long>, data binary"
_BLOCK_KINDS = {"block": pa.string(), "numbers": pa.list_(pa.int64()), "ids": pa.list_(pa.int64()), "keys": pa.list_(pa.binary()), "ends": pa.list_(pa.int64()), "data": pa.binary()}


def block_row(block: str, numbers: np.ndarray, ids: list, keys: list[bytes], ends: np.ndarray, data: bytes) -> pa.RecordBatch:
    values = (block, numbers, ids, keys, ends, pa.compress(data, "zstd", asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, _BLOCK_KINDS.values(), strict=True)], list(_BLOCK_KINDS))


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Starts (one more than texts) and bytes of a block's row."""
    starts = np.concatenate([[0], row["ends"]]).astype(np.int64)
    return starts, np.frombuffer(pa.decompress(row["data"], int(starts[-1]), "zstd", asbytes=True), np.uint8)


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Blocks one by one, so that one of them is in memory at a time."""
    for b in batches:
        for i in range(b.num_rows):
            yield {name: b.column(k)[i].as_py() for k, name in enumerate(b.schema.names)}


def bucket_edges(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket begins in sorted distinct tokens."""
    firsts = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.append(np.searchsorted(tokens, firsts), len(tokens))


def text_bytes(blocks: DataFrame) -> int:
    return blocks.agg(F.sum(F.element_at("ends", -1))).first()[0] or 0


def bucket_bits(blocks: DataFrame) -> int:
    """First bits of a token that name its bucket, from the size of the corpus."""
    return min(MOST_BITS, max(LEAST_BITS, (text_bytes(blocks) // BUCKET_BYTES).bit_length()))


def frequency_codes(blocks: DataFrame, tokens_of: Callable[[dict], list[np.ndarray]]) -> DataFrame:
    """block, codes: a byte for each of the block's sorted distinct tokens.

    ``tokens_of`` gives arrays of uint64 tokens of a block's row, one for each document with each of its tokens once; or,
    where occurrences count, any that hold a token as often as it occurs.  As buckets grow in number, more blocks of a task go
    together, so that a row to a bucket holds some ``ROW_TOKENS`` tokens and rows grow with the corpus, not with its square.
    """
    bits = bucket_bits(blocks)
    together = min(ROW_TOKENS << bits, MOST_TOKENS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            edges = np.stack([bucket_edges(t, bits) for t, _ in held])
            parts = [((t >> np.uint64(32 - bits)).astype(np.uint32), np.minimum(n, 65535).astype(np.uint16)) for t, n in held]
            some = np.flatnonzero((edges[:, 1:] > edges[:, :-1]).any(0)).tolist()
            cut = lambda c: pa.array([b"".join([x[c][e[k] : e[k + 1]].tobytes() for x, e in zip(parts, edges, strict=True)]) for k in some], pa.binary())
            lens = pa.array([(edges[:, k + 1] - edges[:, k]).astype(np.int32).tobytes() for k in some], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([",".join(names)] * len(some), pa.string()), lens, cut(0), cut(1)], ["bucket", "blocks", "lens", "rest", "counts"])

        for row in rows(batches):
            own = tokens_of(row)
            held.append(np.unique(np.concatenate(own) if own else np.array([], np.uint64), return_counts=True))
            names.append(row["block"])
            size += len(held[-1][0])
            if size >= together:
                yield out()
                names, held, size = [], [], 0
        if names:
            yield out()

    def count(group: pa.Table) -> pa.Table:
        blobs = group.column("rest").to_pylist()
        rest = np.frombuffer(b"".join(blobs), np.uint32)
        counts = np.frombuffer(b"".join(group.column("counts").to_pylist()), np.uint16)
        order = np.argsort(rest, kind="stable")
        ranked = rest[order]
        new = np.empty(len(rest), bool)
        new[:1], new[1:] = True, ranked[1:] != ranked[:-1]
        starts = np.flatnonzero(new)
        sums = np.add.reduceat(counts[order].astype(np.int64), starts)
        code = np.where(sums > 1, 1 + (2 * np.log2(np.maximum(sums, 2))).astype(np.int64), 0).astype(np.uint8)
        back = np.empty(len(rest), np.uint8)
        back[order] = np.repeat(code, np.diff(np.append(starts, len(rest))))
        ends = np.cumsum([len(b) // 4 for b in blobs])
        codes = pa.array([back[e - len(b) // 4 : e].tobytes() for e, b in zip(ends, blobs, strict=True)], pa.binary())
        return pa.table({"bucket": group.column("bucket"), "blocks": group.column("blocks"), "lens": group.column("lens"), "codes": codes})

    def deal(group: pa.Table) -> pa.Table:
        """Codes of the blocks that went together, from all buckets: by block, then by bucket."""
        names = group.column("blocks")[0].as_py().split(",")
        order = np.argsort(group.column("bucket").to_numpy(), kind="stable").tolist()
        lens, codes = ([group.column(c)[k].as_py() for k in order] for c in ("lens", "codes"))
        flat = np.frombuffer(b"".join(codes), np.uint8)
        each = np.frombuffer(b"".join(lens), np.int32)
        of = np.repeat(np.tile(np.arange(len(names), dtype=np.uint32), len(lens)), each)
        ends = np.cumsum(np.bincount(of, minlength=len(names)))
        flat = flat[np.argsort(of, kind="stable")]
        return pa.table({"block": names, "codes": pa.array([flat[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)], pa.binary())})

    sent = blocks.mapInArrow(send, "bucket int, blocks string, lens binary, rest binary, counts binary")
    counted = sent.groupBy("bucket").applyInArrow(count, "bucket int, blocks string, lens binary, codes binary")
    # What a block gets back is a byte for each of its tokens.
    out = settle(counted.groupBy("blocks").applyInArrow(deal, "block string, codes binary"))
    release()
    return out


def codes_of(row: dict) -> np.ndarray:
    """The codes of the block's sorted distinct tokens, in their order."""
    return np.frombuffer(row["codes"] or b"", np.uint8)


def release() -> None:
    """Let Spark's cleaner drop the shuffle files of jobs that are done."""
    from pyspark import SparkContext

    gc.collect()
    if SparkContext._active_spark_context is not None:
        SparkContext._active_spark_context._jvm.System.gc()
