"""Benchmark decontamination by latent semantic retrieval.

Words are hashed to features; document frequencies of the features are counted over all passages of the corpus.  A
randomised singular value decomposition of TF-IDF passages (range finder with one power iteration; every pass is a
distributed sum of small matrices) gives a latent space.  It is fitted on all passages of all documents, and every word of
every document is indexed: windows of about each item's length slide over the whole text.  A window is a candidate for an item if their cosine in that space reaches ``cosine``; where the space can't tell, as
one of the two has no vector, it is one in any case.  Candidates whose 1,024-bit word signatures rule the subsequence out
are dropped.  The others are verified by the longest common subsequence of words of the item and the text around the
window, and by whether the item's answer stands there.

A document is contaminated by an item if the subsequence has ``high`` of the item's words, or ``low`` of them and the answer.
The answer is the item's last sentence, or column ``answer`` where the benchmark has it.  Items of fewer than ``LEAST_WORDS`` words
are too short for a window; they contaminate the documents that hold all their words in a row, which is looked up exactly.

The benchmark is read in batches of ``BATCH_ITEMS`` items, of which driver and tasks hold one at a time.

Defined results: null and empty texts and items without a word match nothing; of several windows that confirm an item the one
of the best subsequence, then cosine, is reported; a null id is reported as null; ids must be numbers that fit a long; repeated rows
are reported each; empty tables give empty results; very long texts are read whole; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevein.llm.blocks import mix, release
from lodevein.llm.common import discard, settle
from lodevein.llm.words import PUNCTUATION, word_hashes

FEATURES = 1 << 14
RANK = 64
PASSAGE = 64
#: Passages that are multiplied at a time: a table of so many by the features that they hold.
LINES = 16
#: Least cosine of a candidate.
COSINE = 0.15
HIGH, LOW = 0.8, 0.6
LEAST_WORDS = 8
UNIT = 4
BATCH_ITEMS = 1 << 14
#: Words that a task searches at a time, and arrays that are added in one.
STEP = 1 << 13
FAN_IN = 64
#: Bytes of text, or of word numbers, that a task works on at a time (or those of one document).
TEXT_BYTES = 1 << 20
SEED = 11

def word_ids(raw: bytes) -> np.ndarray:
    """32-bit word hashes; the first bits are the feature."""
    return (word_hashes(np.frombuffer(raw, np.uint8), breaks=PUNCTUATION)[0] >> np.uint64(32)).astype(np.uint32)


def features(ids: np.ndarray) -> np.ndarray:
    return (ids >> np.uint32(32 - 14)).astype(np.int64)


def window_length(words: int) -> int:
    """The nearest of 8, 12, 16, 24, 32, 48, ..."""
    sizes = [8, 12]
    while sizes[-1] < 2 * words:
        sizes.append(2 * sizes[-2])
    return min(sizes, key=lambda s: abs(np.log(s / words)))


def stride(length: int) -> int:
    return max(UNIT, length // 3 // UNIT * UNIT)


@dataclass(frozen=True)
class Item:
    item_id: int
    ids: np.ndarray
    answer: np.ndarray


def read_items(benchmark: DataFrame) -> list[Item]:
    """The items of a batch that have a word."""
    own = "answer" in benchmark.columns
    rows = benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text", *(["answer"] if own else [])).collect()
    out = []
    for r in sorted(rows, key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"])):
        ids = word_ids(r["text"].encode())
        if not len(ids):
            continue
        answer = r["answer"] if own else None
        if not answer:
            ends = [s for s in r["text"].replace("?", ".").replace("!", ".").replace("\n", ".").split(".") if s.strip()]
            answer = ends[-1] if ends else ""
        out.append(Item(r["item_id"], ids, word_ids(answer.encode())))
    return out


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings or binaries in a row, not copied, and where each value begins in them, and last where they end; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, starts, data = column.buffers()
    return np.frombuffer(data or b"", np.uint8), np.frombuffer(starts, np.int64)[column.offset : column.offset + len(column) + 1]


def _groups(starts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """First and end of values in a row that have ``most`` bytes at most, or are one."""
    at = 0
    while at < len(starts) - 1:
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + most, "right")) - 1)
        yield at, to
        at = to


def tokenised(docs: DataFrame) -> DataFrame:
    """doc_id, ids: the words of a document, as 32-bit numbers.

    Readers and Arrow put thousands of rows in a batch, whatever their size, so a row has no more than its document.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            raw, starts = _flat(b.column("text"))
            for at, to in _groups(starts, TEXT_BYTES):
                words, firsts = word_hashes(raw[starts[at] : starts[to]], starts[at : to + 1] - starts[at], PUNCTUATION)
                ids = (words >> np.uint64(32)).astype(np.uint32)
                places = pa.py_buffer((4 * firsts).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, to - at), pa.Array.from_buffers(pa.binary(), to - at, [None, places, pa.py_buffer(ids)])], ["doc_id", "ids"])

    return settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(split, "doc_id long, ids binary"))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Ids, numbers of words, and words of some documents in a row."""
    for b in batches:
        if not b.num_rows:
            continue
        raw, starts = _flat(b.column("ids"))
        for at, to in _groups(starts, TEXT_BYTES):
            yield b.column("doc_id").slice(at, to - at).to_pylist(), np.diff(starts[at : to + 1]) // 4, raw[starts[at] : starts[to]].view(np.uint32)


def _passages(counts: np.ndarray) -> np.ndarray:
    """The passage of every word: PASSAGE words in turn, none over the end of a document."""
    if not counts.sum():
        return np.array([], np.int64)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    new = within % PASSAGE == 0
    return np.cumsum(new) - 1


def _sum_of(parts: DataFrame, kind: type, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of equal arrays that tasks give in slices (task int, slice int, data binary); the shape is fixed by parameters.

    A group adds ``FAN_IN`` of them at most, in as many rounds as the number of tasks asks for.
    """

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(np.prod(shape), np.float64)[: len(group.column("data")[0].as_py()) // np.dtype(kind).itemsize]
        for x in group.column("data"):
            total = total + np.frombuffer(x.as_py(), kind)
        return pa.table({"task": group.column("to")[:1], "slice": group.column("slice")[:1], "data": pa.array([total.astype(kind).tobytes()], pa.binary())})

    tasks = parts.rdd.getNumPartitions()
    while True:
        to = F.floor(F.col("task") / FAN_IN).cast("int") if tasks > FAN_IN else F.lit(0)
        parts = parts.withColumn("to", to).groupBy("slice", "to").applyInArrow(add, "task int, slice int, data binary")
        if tasks <= FAN_IN:
            break
        tasks = -(-tasks // FAN_IN)
    flat = [np.frombuffer(r["data"], kind).astype(np.float64) for r in sorted(parts.collect(), key=lambda r: r["slice"])]
    return np.concatenate(flat).reshape(shape) if flat else np.zeros(shape)


def _slices(a: np.ndarray, n: int = 32) -> pa.RecordBatch:
    task = pa.array([TaskContext.get().partitionId()] * n, pa.int32())
    return pa.RecordBatch.from_arrays([task, pa.array(range(n), pa.int32()), pa.array([x.tobytes() for x in np.array_split(a.reshape(-1), n)], pa.binary())], ["task", "slice", "data"])


_SLICE = "task int, slice int, data binary"


def frequencies(words: DataFrame) -> np.ndarray:
    """For each feature the passages that hold it, over the whole corpus; last, the number of passages."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 32, np.int64)
        none = np.uint16(65535)
        for _, counts, ids in _rows(batches):
            # A passage is a line of a table, sorted, so that a feature counts once.
            lines = -(-counts // PASSAGE)
            table = np.full((int(lines.sum()), PASSAGE), none, np.uint16)
            gaps = lines * PASSAGE - counts
            table.reshape(-1)[np.arange(len(ids)) + np.repeat(np.cumsum(gaps) - gaps, counts)] = features(ids)
            table.sort(axis=1)
            new = table != none
            new[:, 1:] &= table[:, 1:] != table[:, :-1]
            total[:FEATURES] += np.bincount(table[new], minlength=FEATURES)
            total[FEATURES] += len(table)
        yield _slices(total)

    return _sum_of(words.mapInArrow(count, _SLICE), np.int64, (FEATURES + 32,))[: FEATURES + 1]


def sample_passages(words: DataFrame, share: float) -> DataFrame:
    """ids: passages that a hash of their place in the table chooses, so copies of a passage are chosen one by one; for a look at them, nothing is fitted on it."""
    bar = np.uint64(min(share, 1.0) * ((1 << 64) - 1025))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = TaskContext.get().partitionId() << 36
        for _, counts, ids in _rows(batches):
            p = _passages(counts)
            if not len(p):
                continue
            starts = np.flatnonzero(np.diff(p, prepend=-1))
            h = mix(mix(np.arange(seen + 1, seen + len(starts) + 1, dtype=np.uint64)) + np.uint64(1))
            seen += len(starts)
            ends = np.append(starts[1:], len(ids))
            yield pa.RecordBatch.from_arrays([pa.array([ids[a:b].tobytes() for a, b in zip(starts[h <= bar], ends[h <= bar], strict=True)], pa.binary())], ["ids"])

    return settle(words.mapInArrow(choose, "ids binary"))


def latent_space(words: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = SEED) -> np.ndarray:
    """FEATURES x rank: the leading right singular vectors of the TF-IDF matrix of all passages, each over its singular value.

    Dividing evens out the directions, of which the first only tell languages apart.
    """

    def multiply(basis: np.ndarray):
        basis, weight = basis.astype(np.float32), idf.astype(np.float32)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((FEATURES, rank))
            seen, place = np.zeros(FEATURES, bool), np.zeros(FEATURES, np.int64)
            for _, counts, ids in _rows(batches):
                p, f = _passages(counts), features(ids)
                if not len(p):
                    continue
                w = weight[f]
                w /= np.sqrt(np.maximum(np.bincount(p, w * w), 1e-12)).astype(np.float32)[p]
                edges = np.append(np.searchsorted(p, np.arange(0, p[-1] + 1, LINES)), len(p))
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    own = f[lo:hi]
                    seen[own] = True
                    some = np.flatnonzero(seen)
                    seen[some] = False
                    place[some] = np.arange(len(some))
                    cell = (p[lo:hi] - p[lo]) * len(some) + place[own]
                    table = np.bincount(cell, w[lo:hi], LINES * len(some)).astype(np.float32).reshape(LINES, len(some))
                    total[some] += table.T @ (table @ basis[some])
            yield _slices(total.astype(np.float32))

        return work

    basis = np.random.default_rng(seed).standard_normal((FEATURES, rank))
    for _ in range(2):
        z = _sum_of(words.mapInArrow(multiply(basis), _SLICE), np.float32, (FEATURES, rank))
        basis, r = np.linalg.qr(z + 1e-12 * np.eye(FEATURES, rank))
    turn, squares, _ = np.linalg.svd(r)
    return basis @ turn / np.sqrt(np.maximum(squares, 1e-9))


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence; the bits of one integer hold a row of the table."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        if (m := places.get(x)) is not None:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def _contains(region: np.ndarray, answer: np.ndarray) -> bool:
    n = len(answer)
    if not n or n > len(region):
        return False
    starts = np.flatnonzero(region[: len(region) - n + 1] == answer[0])
    return any(np.array_equal(region[s : s + n], answer) for s in starts)


def _bits(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The one of 1,024 bits that a word sets: which of 16 numbers, and what in it."""
    return (ids >> np.uint32(6)) & np.uint32(15), np.uint64(1) << (ids & np.uint32(63)).astype(np.uint64)


def signature(ids: np.ndarray) -> np.ndarray:
    """The bits that the words set."""
    out = np.zeros(16, np.uint64)
    np.bitwise_or.at(out, *_bits(ids))
    return out


def _fewer(signatures: np.ndarray) -> np.ndarray:
    """Signatures of a quarter of the bits."""
    return np.bitwise_or.reduce(signatures.reshape(len(signatures), 4, 4), axis=1)


def _padded(a: np.ndarray) -> np.ndarray:
    return np.concatenate([a, np.zeros((-len(a) % UNIT, *a.shape[1:]), a.dtype)]) if len(a) % UNIT else a


class Index:
    """Items by window length, and the vectors of all features."""

    def __init__(self, items: list[Item], idf: np.ndarray, basis: np.ndarray, weights: np.ndarray, low: float, cosine: float = COSINE):
        self.items, self.cosine = items, cosine
        vectors = basis * idf[:, None]
        # Every window is as long as its item, so the mean word can go.
        self.vectors = (vectors - np.average(vectors, axis=0, weights=weights + 1e-9)).astype(np.float32)
        lengths: dict[int, list[int]] = {}
        self.short: dict[int, dict[bytes, list[int]]] = {}
        for k, it in enumerate(items):
            if len(it.ids) < LEAST_WORDS:
                self.short.setdefault(len(it.ids), {}).setdefault(it.ids.tobytes(), []).append(k)
            else:
                lengths.setdefault(window_length(len(it.ids)), []).append(k)
        self.by_length = {}
        for length, all_ in lengths.items():
            for at in range(0, len(all_), 1024):  # so many at a time, which bounds the table of cosines
                own = all_[at : at + 1024]
                q = np.stack([self.vectors[features(items[k].ids)].sum(0) for k in own])
                marks = np.stack([signature(items[k].ids) for k in own])
                # Item words that share a bit count once, so as many may be missing from the bits.
                sizes = np.array([len(items[k].ids) for k in own])
                need = [np.ceil(low * sizes).astype(np.int64) - (sizes - np.bitwise_count(m).sum(1)) for m in (_fewer(marks), marks)]
                norm = np.linalg.norm(q, axis=1, keepdims=True)
                blind = norm[:, 0] <= 1e-9  # an item without a vector: any window
                self.by_length[length, at] = own, (q / np.maximum(norm, 1e-9)).T.copy(), marks, need, blind if blind.any() else None

    def candidates(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Length, window starts, items and cosines of what neither the cosine nor the signature rules out."""
        n = len(ids)
        longest = max(length for length, _ in self.by_length)
        reach = (longest // 2 + UNIT - 1) // UNIT * UNIT
        for lo in range(0, n, STEP):
            # A window belongs to the step that it starts in; the text around it reaches half its length to both sides.
            left = max(0, lo - reach)
            part = ids[left : min(n, lo + STEP + 2 * longest)]
            skip = (lo - left) // UNIT
            v = _padded(self.vectors[features(part)])
            unit = v[0::UNIT].copy()
            for k in range(1, UNIT):
                unit += v[k::UNIT]
            sums = np.zeros((len(unit) + 1 + longest // UNIT, unit.shape[1]), np.float32)
            np.cumsum(unit, axis=0, out=sums[1 : len(unit) + 1])
            sums[len(unit) + 1 :] = sums[len(unit)]
            # Bits of 1, 2, 4, ... units; those of any width are two of these.
            which, bit = map(_padded, _bits(part))
            ored = [np.zeros((len(unit) + 2 * (longest + reach) // UNIT, 16), np.uint64)]
            rows = np.arange(len(unit))
            for k in range(UNIT):
                ored[0][rows, which[k::UNIT]] |= bit[k::UNIT]
            while 2 << len(ored) <= 2 * (longest + 2 * reach) // UNIT:
                half = 1 << (len(ored) - 1)
                ored.append(ored[-1].copy())
                ored[-1][:-half] |= ored[-2][half:]
            for (length, _), (own, q, marks, need, blind) in self.by_length.items():
                hop = stride(length) // UNIT
                at = skip + np.arange(0, -(-min(STEP, n - lo) // UNIT), hop)
                x = sums[skip + length // UNIT :: hop][: len(at)] - sums[skip::hop][: len(at)]
                size = np.sqrt(np.einsum("ij,ij->i", x, x))
                cos = x @ q
                least = (size * np.float32(self.cosine) - np.float32(1e-6))[:, None]
                hits = np.flatnonzero(cos >= least if blind is None else (cos >= least) | blind)
                w, k = np.divmod(hits, len(own))
                # The words around the window bound the subsequence from above: first by few bits, then by all.
                half = (length // 2 + UNIT - 1) // UNIT
                first = np.maximum(at - half, 0)
                width = length // UNIT + 2 * half
                level = width.bit_length() - 1
                around = ored[level][first] | ored[level][first + width - (1 << level)]
                for bits, mark, least in ((_fewer(around), _fewer(marks), need[0]), (around, marks, need[1])):
                    keep = np.zeros(len(w), bool)
                    for a in range(0, len(w), 65536):
                        i, j = w[a : a + 65536], k[a : a + 65536]
                        keep[a : a + 65536] = np.bitwise_count(bits[i] & mark[j]).sum(1, dtype=np.int16) >= least[j]
                    w, k = w[keep], k[keep]
                if not len(w):
                    continue
                yield length, left + at[w] * UNIT, np.array(own)[k], cos[w, k] / np.maximum(size[w], 1e-9)

    def in_a_row(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """(place, item) of all short items that stand in the words."""
        for n, own in self.short.items():
            runs = np.lib.stride_tricks.sliding_window_view(ids, n) if len(ids) >= n else np.zeros((0, n), np.uint32)
            firsts = np.unique([np.frombuffer(x, np.uint32)[0] for x in own])
            for place in np.flatnonzero(np.isin(runs[:, 0], firsts)).tolist():
                for k in own.get(runs[place].tobytes(), ()):
                    yield place, k

    def search(self, names: list, counts: np.ndarray, ids: np.ndarray, low: float) -> Iterator[tuple]:
        """(doc_id, item_id, cosine, lcs_ratio, answer_found) of every verified candidate of these documents."""
        n = len(ids)
        if not n:
            return
        ends = np.cumsum(counts)
        best: dict[tuple[int, int], tuple] = {}
        for length, starts, items, cosines in self.candidates(ids) if self.by_length else ():
            docs = np.searchsorted(ends, np.minimum(starts + length // 2, n - 1), "right")
            for start, doc, k, c in zip(starts.tolist(), docs.tolist(), items.tolist(), cosines.tolist(), strict=True):
                item = self.items[k]
                a, b = max(start - length // 2, int(ends[doc] - counts[doc])), min(start + length + length // 2, int(ends[doc]))
                ratio = common_subsequence(item.ids, ids[a:b]) / len(item.ids)
                if ratio >= low:
                    best[doc, k] = max(best.get((doc, k), (0.0,)), (ratio, c, _contains(ids[a:b], item.answer)))
        for place, k in self.in_a_row(ids):
            doc = int(np.searchsorted(ends, place, "right"))
            item = self.items[k]
            if place + len(item.ids) <= ends[doc]:
                best[doc, k] = 1.0, 1.0, _contains(ids[place : place + len(item.ids)], item.answer)
        for (doc, k), (ratio, near, answer) in sorted(best.items()):
            yield names[doc], self.items[k].item_id, near, ratio, answer


def contaminations(docs: DataFrame, benchmark: DataFrame, cosine: float = COSINE, high: float = HIGH, low: float = LOW) -> DataFrame:
    """doc_id, item_id, cosine, lcs_ratio, answer_found for every document and item that contaminates it."""
    schema = "doc_id long, item_id long, cosine double, lcs_ratio double, answer_found boolean"
    spark = docs.sparkSession
    batches = -(-benchmark.filter("text is not null").count() // BATCH_ITEMS)
    if not batches:
        return spark.createDataFrame([], schema)
    words = tokenised(docs)
    df = frequencies(words)
    total = df[FEATURES]
    idf = np.log((1 + total) / (1 + df[:FEATURES]))
    basis = latent_space(words, idf)
    release()
    out = None
    for at in range(batches):
        items = read_items(benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(batches)) == at))
        if not items:
            continue
        shared = spark.sparkContext.broadcast(Index(items, idf, basis, df[:FEATURES], low, cosine))

        def search(rows: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for names, counts, ids in _rows(rows):
                found = [x for x in shared.value.search(names, counts, ids, low) if x[3] >= high or x[4]]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)], ["doc_id", "item_id", "cosine", "lcs_ratio", "answer_found"])

        found = settle(words.mapInArrow(search, schema))
        shared.unpersist()
        out = found if out is None else out.union(found)
    discard(words)
    return spark.createDataFrame([], schema) if out is None else out
