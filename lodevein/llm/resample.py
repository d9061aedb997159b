"""Target-distribution importance resampling: draw the documents that look most like a target corpus.

Features are all runs of 1 to ``longest`` words, in hashed buckets.  Each partition walks its texts through a trie of words: a node is a run, holds
how often the run came by, and the state of the CRC of its text, which the node below goes on from.  A partition gives its totals by bucket
whenever the trie holds ``NODES`` nodes, and begins a new one, so its memory doesn't grow with the vocabulary; Spark adds
the totals, and the gain of each of the buckets follows from those of the corpus and of the target.  A second walk, now with gains at the nodes, scores
each document by the mean of its features' gains; noise from a hash of its id makes the best scores a draw without replacement.

The draw is exact without a sort in one task: a histogram of scores gives the last score that is drawn, what reaches it is
sorted by ranges, and a document's rank is its place in its range and the sizes of the ranges before.

Defined results: a null text has no words; a document without features has weight 0; rows that repeat an id are documents of their
own, in the order of their features and texts; a row without id has a null score, isn't among those to draw from and isn't drawn, but
its words count; texts are read whole, however long; an empty target, or an empty table, is one of no features; further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevein.llm.common import settle

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
SHARE = 10
#: Nodes of a trie at most, but for those of one text.
NODES = 1 << 18
#: Words that are walked at once.
STRIDE = 1 << 16

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


class Trie(dict):
    """Nodes by (node above, word); ``crc`` and ``count`` have an entry for each node, 0 is the root."""

    def __init__(self, gains: np.ndarray | None = None) -> None:
        self.crc, self.gain, self.gains = [0], [0], gains

    def __missing__(self, edge: tuple[int, bytes]) -> int:
        above, word = edge
        crc = zlib.crc32(b" " + word if above else word, self.crc[above])
        self[edge] = node = len(self.crc)
        self.crc.append(crc)
        if self.gains is not None:
            self.gain.append(int(self.gains[crc % len(self.gains)]))
        return node

    def walk(self, words: list[bytes], longest: int) -> Iterator[list[int]]:
        """The nodes of all runs of one word, of two, and so on, in strides."""
        for at in range(0, len(words), STRIDE):
            part = words[at : at + STRIDE + longest - 1]
            nodes: list[int] = list(map(self.__getitem__, zip(repeat(0), part)))
            yield nodes[:STRIDE]
            for k in range(1, longest):
                nodes = list(map(self.__getitem__, zip(nodes, part[k:])))
                if nodes:
                    yield nodes[:STRIDE]


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of letters, digits and other than ASCII characters, A-Z as a-z."""
    return (text or b"").translate(_LETTERS).split()


def bucket_totals(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: features of all texts by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, counts = Trie(), np.zeros(1 << 12, np.int64)

        def totals() -> pa.RecordBatch:
            sums = np.zeros(buckets, np.int64)
            np.add.at(sums, np.array(trie.crc, np.int64)[1:] % buckets, counts[1 : len(trie.crc)])
            some = np.flatnonzero(sums)
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sums[some])], ["bucket", "n"])

        for b in batches:
            for text in b.column("text").cast(pa.binary()):
                for nodes in trie.walk(words_of(text.as_py()), longest):
                    if len(trie.crc) > len(counts):
                        counts = np.concatenate([counts, np.zeros(len(trie.crc), np.int64)])
                    np.add.at(counts, nodes, 1)
                if len(trie.crc) > NODES:
                    yield totals()
                    trie, counts = Trie(), np.zeros(1 << 12, np.int64)
        yield totals()

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket int, n long")
    return found.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """A thousand times the logarithm of each bucket's smoothed share of the target over that of the corpus, from the totals of both; they are ``buckets`` rows at most."""
    both = []
    for totals in (corpus, target):
        own = np.zeros(buckets, np.int64)
        for r in totals.collect():
            own[r["bucket"]] = r["n"]
        both.append(own.tolist())
    (s_of, t_of), (s_all, t_all) = both, map(sum, both)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + float(buckets)) / ((s + 1.0) * (t_all + float(buckets))))) for s, t in zip(s_of, t_of, strict=True)], np.int64)


def scores(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, tie for every document; ``tie`` tells texts of one id and score apart."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(gain)
        for b in batches:
            out: list[tuple] = []
            for text, noise in zip(b.column("text").cast(pa.binary()), b.column("h").to_pylist(), strict=True):
                words = words_of(text.as_py())
                n = total = 0
                for nodes in trie.walk(words, longest):
                    n += len(nodes)
                    total += sum(map(trie.gain.__getitem__, nodes))
                weight = total // n if n else 0
                own = None if noise is None else weight + math.floor(-1000 * math.log(-math.log((noise + 0.5) / 4294967296)))
                out.append((len(words), n, weight, own))
                if len(trie.crc) > NODES:
                    trie = Trie(gain)
            columns = [pa.array([x[k] for x in out], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns, b.column("tie")], ["doc_id", "n_words", "n_features", "weight", "score", "tie"])

    text, doc = F.col("text").cast("string"), F.col("doc_id").cast("long")
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit("2024:"), doc.cast("string")), 256), 1, 8), 16, 10).cast("long")
    rows = docs.select(doc.alias("doc_id"), text.alias("text"), noise.alias("h"), F.xxhash64(text).alias("tie"))
    return rows.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long, tie long")


def ranked(scored: DataFrame, size: int) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 and so on for the ``size`` best by score and smallest doc_id, null for the others and where score is null."""
    # Scores are thousandths of logarithms of numbers of 64 bits, so there are some 100,000 values at most.
    histogram = sorted(((r["score"], r["count"]) for r in scored.filter("score is not null").groupBy("score").count().collect()), reverse=True)
    least, have = None, 0
    for score, n in histogram:
        if have >= size:
            break
        least, have = score, have + n
    none = F.lit(None).cast("long")
    if least is None:
        return scored.withColumn("rank", none)
    good = F.coalesce(F.col("score") >= least, F.lit(False))
    order = [F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("tie")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(seen + 1, seen + n + 1))], [*b.schema.names, "part", "place"])
            seen += n

    # One number for both directions of the order, which ranges and the sort inside them share.
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scored.schema)
    sorted_ = scored.filter(good).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = settle(sorted_.mapInArrow(place, f"{kind}, part int, place long"))
    before, so_far = [], 0
    for r in placed.groupBy("part").count().orderBy("part").collect():
        before.append((r["part"], so_far))
        so_far += r["count"]
    offsets = scored.sparkSession.createDataFrame(before, "part int, before long")
    rank = F.col("place") + F.col("before")
    drawn = placed.join(F.broadcast(offsets), "part").select(*scored.columns, F.when(rank <= size, rank).alias("rank"))
    return drawn.unionByName(scored.filter(~good).withColumn("rank", none))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; of those of ``least_words`` words, ``share`` hundredths are drawn."""
    gain = gains(bucket_totals(docs, longest, buckets), bucket_totals(target, longest, buckets), buckets)
    scored = settle(scores(docs, gain, longest))
    fit = F.coalesce(F.col("n_words") >= least_words, F.lit(False)) & F.col("doc_id").isNotNull()
    size = share * scored.filter(fit).count() // 100
    drawn = ranked(scored.filter(fit), size).unionByName(scored.filter(~fit).withColumn("rank", F.lit(None).cast("long")))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


#: The same rows for DuckDB, which has no CRC: its table is eight steps of the polynomial for each byte.
RESAMPLE_SQL = """
WITH poly AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
words AS (
  SELECT rid, doc_id, corpus, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word
  FROM (SELECT row_number() OVER () AS rid, doc_id, text, true AS corpus FROM documents UNION ALL SELECT NULL, NULL, text, false FROM benchmark)),
names AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)),
                               lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM words), poly),
featured AS (SELECT w.rid, w.corpus, n.bucket FROM words w JOIN names n USING (word)),
totals AS (SELECT bucket, count(*) FILTER (corpus) AS s, count(*) FILTER (NOT corpus) AS t FROM featured GROUP BY bucket),
both_ AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM totals),
gain AS (SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (s_all + 10000.0::DOUBLE) / ((s + 1.0::DOUBLE) * (t_all + 10000.0::DOUBLE))))::BIGINT AS gain FROM totals, both_),
own AS (SELECT rid, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM featured JOIN gain USING (bucket) WHERE corpus GROUP BY rid),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM (SELECT row_number() OVER () AS rid, doc_id FROM documents) d LEFT JOIN own USING (rid)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id, n_features) AS place, (SELECT count(*) FROM scored WHERE n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM placed
"""
