"""Suffix-array dedup: remove bytes that 50-byte strings of earlier documents cover.

Documents of one text are one class, of which the first alone is looked at; the others are covered as a whole.  Texts are
packed into blocks.  A window of 50 bytes is named by its minimizer, the least hash of its 26-byte grams; equal
windows have equal minimizers, so windows whose minimizer occurs in a single document (an exact count over the
corpus) can't repeat and are dropped.  The others are cut into maximal runs of one minimizer, and the bytes of a run go, once
for each block, to the bucket of that minimizer.  Windows of very frequent minimizers go one by one to a bucket of their
own hash, so that no passage, however common, gathers its neighbours in one task.  Hashes only bring strings together: the bytes of
strings of one hash are compared, and different strings of one name, common or not, all go through the transform.

In a bucket a Burrows-Wheeler transform of the runs is extended backward breadth first: a boundary between suffixes
that have a common prefix of l bytes gives the boundaries of value l + 1 in front of them.  The expansion stops at the
minimum length; boundaries not reached by then lie within groups of suffixes with a common prefix of 50 bytes, and
each group has its smallest document.

Defined results: a null text is empty; offsets are bytes of UTF-8; rows of one id aren't earlier than each other; a null id
comes after all others and isn't earlier than another null id; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevein.llm import blocks as B
from lodevein.llm.common import discard, settle

LENGTH = 50
GRAM = 26
#: Code of document frequency (1 + 2 log2 n) from which windows go one by one: 2,048 documents.
HOT_CODE = 23
#: Windows in a run at most, and bytes in a Burrows-Wheeler transform, whose arrays then fit a cache; strings of one minimizer are never parted.
RUN = 256
BATCH_BYTES = 1 << 18
NULL_ID = np.iinfo(np.int64).max

_BASE = 0x9E3779B97F4A7C15


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all grams of that many bytes, by doubling: a gram of a + b bytes from those of a and of b."""
    h = {1: B.mix(raw.astype(np.uint64) + np.uint64(1))}
    power = 1
    while 2 * power <= size:
        a = h[power]
        h[2 * power] = a[: len(a) - power] * np.uint64(pow(_BASE, power, 1 << 64)) + a[power:] if len(a) > power else a[:0]
        power *= 2
    out, have = h[power], power
    while have < size:
        p = 1 << ((size - have).bit_length() - 1)
        n = max(0, len(raw) - have - p + 1)
        out = out[:n] * np.uint64(pow(_BASE, p, 1 << 64)) + h[p][have : have + n]
        have += p
    return B.mix(out)


def minimizers(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """The least gram hash of every window of a text."""
    if len(raw) < length:
        return np.array([], np.uint64)
    m, width, have = gram_hashes(raw, gram), length - gram + 1, 1
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(m) - (width - have)], m[width - have :]) if have < width else m


def _pieces(row: dict, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    starts, raw = B.unpack(row)
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        yield raw[a:b], minimizers(raw[a:b], length, gram)


def runs(m: np.ndarray, code: np.ndarray, hot_code: int = HOT_CODE) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each run, from minimizers and their codes."""
    shared = code > 0
    hot = code >= hot_code
    new = np.ones(len(m), bool)
    new[1:] = (m[1:] != m[:-1]) | hot[1:] | hot[:-1]
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(m)))
    keep = shared[first]
    first, n = first[keep], n[keep]
    if len(n) and n.max() > RUN:  # a long run of one value, as in a text of one letter
        times = -(-n // RUN)
        k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        first, n = np.repeat(first, times) + k * RUN, np.minimum(np.repeat(n, times) - k * RUN, RUN)
    return first, n


def gather(raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of slices, one after another."""
    ends = np.cumsum(size)
    return raw[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)]


def slice_hashes(raw: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each of the slices that lie one after another in ``raw``."""
    if not len(size):
        return np.array([], np.uint64)
    starts = np.cumsum(size) - size
    at = np.arange(len(raw)) - np.repeat(starts, size)
    power = np.full(int(size.max()) + 1, _BASE, np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    return B.mix(np.add.reduceat(B.mix(raw.astype(np.uint64) + np.uint64(1)) * power[at], starts) + size.astype(np.uint64))


def differ_from_last(data: np.ndarray, starts: np.ndarray, size: np.ndarray, order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Which strings, in this order, aren't the one before; equal keys are no proof, the bytes are."""
    new = np.ones(len(order), bool)
    a, b = order[:-1], order[1:]
    alike = size[a] == size[b]
    for k in keys:
        alike &= k[a] == k[b]
    pairs = np.flatnonzero(alike)
    new[1:] = ~alike
    if len(pairs):
        n = size[a[pairs]]
        apart = gather(data, starts[a[pairs]], n) != gather(data, starts[b[pairs]], n)
        new[pairs[np.add.reduceat(apart.astype(np.int64), np.cumsum(n) - n) > 0] + 1] = True
    return new


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of an integer text of distinct separators, by doubling."""
    n = len(text)
    bits = int(text.max()).bit_length()
    step = max(1, 62 // max(1, bits))  # as many symbols as one number holds come first
    key = np.zeros(n, np.int64)
    for i in range(step):
        key <<= bits
        key[: max(0, n - i)] |= text[i:]
    while True:
        order = np.argsort(key)  # equal keys get one rank, so their order doesn't matter
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
        if rank[order[-1]] == n - 1:
            return order
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 2) + ahead
        step *= 2


def equal_windows(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and for each the number of its group: suffixes share a group if their first ``length`` symbols are equal.

    The boundaries come from the Burrows-Wheeler transform alone: between neighbours i - 1 and i of the order, the common
    prefix behind a symbol c is one longer than the least common prefix between the last two places of c.
    """
    n = len(text)
    order = suffix_order(text)
    bwt = text[order - 1]  # the text is taken as a circle; its last symbol is a separator that occurs once
    small = bwt.astype(np.uint16) if text.max() < 1 << 16 else bwt  # short numbers sort by their digits
    lf_order = np.argsort(small, kind="stable")  # place k of this list maps to row k
    before = np.empty(n, np.int64)  # the row that the place before, of the same symbol, has
    before[0] = -1
    before[1:] = np.where(bwt[lf_order[1:]] == bwt[lf_order[:-1]], lf_order[:-1], -1)
    unset = np.ones(n, bool)
    unset[before < 0] = False  # first rows of a symbol: no common prefix, value 0
    open_rows = np.flatnonzero(unset)
    for _ in range(1, length):
        # Boundaries so far have values under l; a row whose two places are parted by one has a value of l at most.
        parted = np.cumsum(~unset)
        reached = parted[lf_order[open_rows]] != parted[before[open_rows]]
        if not reached.any():
            break
        unset[open_rows[reached]] = False
        open_rows = open_rows[~reached]
    return order, np.cumsum(~unset) - 1


def smallest_documents(raw: np.ndarray, size: np.ndarray, docs: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For the strings that lie one after another in ``raw``, with a document each: the smallest document of every window, string after string."""
    k = len(size)
    ends = np.cumsum(size)
    at = np.arange(len(raw)) + np.repeat(np.arange(k), size)
    text = np.empty(len(raw) + k, np.int64)
    text[at] = raw.astype(np.int64) + k
    text[ends + np.arange(k)] = np.arange(k)[::-1]  # separators are distinct and less than bytes; the last is the least
    order, group = equal_windows(text, length)
    owner = np.empty(len(text), np.int64)
    owner[at] = np.repeat(np.arange(k), size)
    owner[ends + np.arange(k)] = np.arange(k)
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    least = np.minimum.reduceat(docs[owner[order]], starts)
    of = np.empty(len(text), np.int64)
    of[order] = least[group]
    windows = size - length + 1
    first = ends - size + np.arange(k)
    return of[np.arange(windows.sum()) + np.repeat(first - (np.cumsum(windows) - windows), windows)]


_SENT = "bucket int, block string, names binary, sizes binary, docs binary, data binary"


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_code: int = HOT_CODE) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256, kept (null where nothing was removed) for docs(key, doc_id, text), each text once."""
    packed = B.pack(docs)

    def tokens(row: dict) -> list[np.ndarray]:
        return [np.unique(m) for _, m in _pieces(row, length, gram)]

    codes = B.frequency_codes(packed, tokens)
    buckets = max(64, B.text_bytes(packed) >> 22)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of two kinds: what a bucket gets of a block, and, of bucket -1, the block's layout; a document without shared windows is done."""
        for row in B.rows(batches):
            pieces = list(_pieces(row, length, gram))
            known = np.unique(np.concatenate([m for _, m in pieces])) if pieces else np.array([], np.uint64)
            code = B.codes_of(row)
            ids = np.array([NULL_ID if i is None else i for i in row["ids"]], np.int64)
            first, count, doc, name, data = [], [], [], [], []
            for k, (raw, m) in enumerate(pieces):
                if not len(m):
                    continue
                c = code[np.searchsorted(known, m)]
                f, n = runs(m, c, hot_code)
                if len(f):
                    data.append(gather(raw, f, n + length - 1))
                    first.append(f)
                    count.append(n)
                    doc.append(np.full(len(f), k))
                    name.append(np.where(c[f] >= hot_code, np.uint64(0), m[f]))
            out: dict[str, list] = {x: [] for x in ("bucket", "block", "names", "sizes", "docs", "data", "layout")}

            def add(bucket: int, block: str, names: bytes | None, sizes: bytes | None, doc_ids: bytes | None, blob: bytes | None, layout: dict | None, out: dict = out) -> None:
                for x, v in zip(out, (bucket, block, names, sizes, doc_ids, blob, layout), strict=True):
                    out[x].append(v)

            some = np.zeros(len(pieces), bool)
            layout = {"first": b"", "count": b"", "doc": b"", "string": b"", "later": b"", "strings": b""}
            if first:
                first, count, doc, name, data = map(np.concatenate, (first, count, doc, name, data))
                size = count + length - 1
                h = slice_hashes(data, size)
                name = np.where(name == 0, h, name)  # hot windows are named by their own hash
                # Once for each block: the string with the smallest of its documents.
                order = np.lexsort((ids[doc], h, name))
                starts = np.cumsum(size) - size
                new = differ_from_last(data, starts, size, order, h, name)
                string = np.empty(len(order), np.int64)
                string[order] = np.cumsum(new) - 1
                unique = order[new]
                least = ids[doc[unique]]
                bucket = (name[unique] % np.uint64(buckets)).astype(np.int64)
                by_bucket = np.argsort(bucket, kind="stable")
                place = np.empty(len(unique), np.int64)
                place[by_bucket] = np.arange(len(unique))
                edges = np.flatnonzero(np.diff(bucket[by_bucket], prepend=-1))
                for a, b in zip(edges, np.append(edges[1:], len(by_bucket)), strict=True):
                    u = by_bucket[a:b]
                    add(int(bucket[u[0]]), row["block"], name[unique[u]].tobytes(), size[unique[u]].astype(np.int32).tobytes(), least[u].tobytes(), gather(data, starts[unique[u]], size[unique[u]]).tobytes(), None)
                some[doc] = True
                kept_doc = np.cumsum(some) - 1
                layout = {
                    "first": first.astype(np.int64).tobytes(), "count": count.astype(np.int16).tobytes(), "doc": kept_doc[doc].astype(np.int32).tobytes(), "string": place[string].astype(np.int32).tobytes(),
                    "later": _bits(ids[doc] > least[string]), "strings": size[unique[by_bucket]].astype(np.int16).tobytes(),
                }
            layout["done"] = [{"key": i, "n_bytes": len(raw), "sha": hashlib.sha256(raw).hexdigest()} for i, (raw, _), s in zip(row["keys"], pieces, some, strict=True) if not s]
            layout["keys"] = [i for i, s in zip(row["keys"], some, strict=True) if s]
            layout["sizes"] = [len(raw) for (raw, _), s in zip(pieces, some, strict=True) if s]
            layout["raw"] = pa.compress(b"".join(raw.tobytes() for (raw, _), s in zip(pieces, some, strict=True) if s), "zstd", asbytes=True)
            add(-1, row["block"], None, None, None, None, layout)
            kinds = {f.name: f.type for f in LAYOUT_ARROW}
            yield pa.RecordBatch.from_arrays([pa.array(out[x], kinds[x]) for x in out], list(out))

    laid = settle(packed.join(codes, "block", "left").mapInArrow(cut, LAYOUT))
    B.release()
    discard(packed, codes)
    sent = laid.filter("bucket >= 0").drop("layout")

    def compare(group: pa.Table) -> pa.Table:
        names = np.frombuffer(b"".join(group.column("names").to_pylist()), np.uint64)
        size = np.frombuffer(b"".join(group.column("sizes").to_pylist()), np.int32).astype(np.int64)
        owner = np.frombuffer(b"".join(group.column("docs").to_pylist()), np.int64)
        data = np.frombuffer(b"".join(group.column("data").to_pylist()), np.uint8)
        starts = np.cumsum(size) - size
        h = slice_hashes(data, size)
        # Equal strings of all blocks, byte for byte, are one string with their smallest document.
        order = np.lexsort((h, names))
        new = differ_from_last(data, starts, size, order, h, names)
        begins = np.flatnonzero(new)
        string = np.empty(len(order), np.int64)
        string[order] = np.cumsum(new) - 1
        unique = order[begins]
        least = np.minimum.reduceat(owner[order], begins)
        windows = size[unique] - length + 1
        at = np.cumsum(windows) - windows
        of = np.repeat(least, windows)
        # Only strings that share their minimizer with another one need the transform.
        name = names[unique]
        pair = np.zeros(len(name), bool)
        same = name[1:] == name[:-1]
        pair[1:] |= same
        pair[:-1] |= same
        todo = np.flatnonzero(pair)
        lo = 0
        while lo < len(todo):
            hi = int(np.searchsorted(np.cumsum(size[unique[todo[lo:]]]), BATCH_BYTES, "right")) + lo
            hi = max(hi, lo + 1)
            while hi < len(todo) and name[todo[hi]] == name[todo[hi - 1]]:  # a minimizer's strings stay together
                hi += 1
            u = todo[lo:hi]
            found = smallest_documents(gather(data, starts[unique[u]], size[unique[u]]), size[unique[u]], least[u], length)
            of[np.arange(windows[u].sum()) + np.repeat(at[u] - (np.cumsum(windows[u]) - windows[u]), windows[u])] = found
            lo = hi
        # For each block: which windows of its strings occur in a document before the string's own.
        n = windows[string]
        flags = of[np.arange(n.sum()) + np.repeat(at[string] - (np.cumsum(n) - n), n)] < np.repeat(owner, n)
        lens = np.array([len(x) // 4 for x in group.column("sizes").to_pylist()])
        ends = np.cumsum(n)[np.cumsum(lens) - 1]
        masks = [_bits(flags[a:b]) for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)]
        return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "mask": pa.array(masks, pa.binary()), "n": pa.array(np.diff(ends, prepend=0), pa.int64())})

    masks = settle(sent.groupBy("bucket").applyInArrow(compare, "block string, bucket int, mask binary, n long").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "mask", "n"))).alias("masks")))
    layouts = laid.filter("bucket < 0").select("block", "layout.*").join(masks, "block", "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.rows(batches):
            out = [(d["key"], d["n_bytes"], 0, 0, d["sha"], None) for d in row["done"]]
            raw = np.frombuffer(pa.decompress(row["raw"], sum(row["sizes"]), "zstd", asbytes=True), np.uint8)
            if row["keys"]:
                own = [np.unpackbits(np.frombuffer(m["mask"], np.uint8), count=m["n"]) for m in row["masks"] or []]
                flags = np.concatenate(own).astype(bool)
                first, count, doc, string = (np.frombuffer(row[c], t).astype(np.int64) for c, t in (("first", np.int64), ("count", np.int16), ("doc", np.int32), ("string", np.int32)))
                later = np.unpackbits(np.frombuffer(row["later"], np.uint8), count=len(first)).astype(bool)
                windows = np.frombuffer(row["strings"], np.int16).astype(np.int64) - length + 1
                at = np.cumsum(windows) - windows
                ends = np.cumsum(row["sizes"])
                base = (ends - row["sizes"])[doc] + first
                within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                hit = np.repeat(later, count) | flags[np.repeat(at[string], count) + within]
                place = np.repeat(base, count)[hit] + within[hit]
                change = np.bincount(place, minlength=len(raw) + 1) - np.bincount(place + length, minlength=len(raw) + 1)[: len(raw) + 1]
                gone = np.cumsum(change)[: len(raw)] > 0
                for i, n, e in zip(row["keys"], row["sizes"], ends, strict=True):
                    g, r = gone[e - n : e], raw[e - n : e]
                    spans = int(np.count_nonzero(np.diff(g.view(np.int8), prepend=0) == 1))
                    kept = r[~g].tobytes()
                    out.append((i, n, int(g.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if spans else None))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return layouts.mapInArrow(finish, "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


_PARTS = "first binary, count binary, doc binary, string binary, later binary, strings binary, done array<struct<key:binary,n_bytes:long,sha:string>>, keys array<binary>, sizes array<long>, raw binary"
LAYOUT = f"{_SENT}, layout struct<{', '.join(f'{p.split()[0]}: {p.split()[1]}' for p in _PARTS.split(', '))}>"
_DONE = pa.list_(pa.struct([("key", pa.binary()), ("n_bytes", pa.int64()), ("sha", pa.string())]))
LAYOUT_ARROW = [
    pa.field("bucket", pa.int32()), pa.field("block", pa.string()), *[pa.field(c, pa.binary()) for c in ("names", "sizes", "docs", "data")],
    pa.field("layout", pa.struct([(c, pa.binary()) for c in ("first", "count", "doc", "string", "later", "strings")] + [("done", _DONE), ("keys", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64())), ("raw", pa.binary())])),
]


def summary(docs: DataFrame, hot_code: int = HOT_CODE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document."""
    member, classes, once = B.distinct_texts(docs)
    done = remove_repeats(once, hot_code=hot_code).drop("kept")
    of_key = member.join(classes, "key").join(settle(done), "key")
    # A later copy is covered by the first as a whole, if it has a window at all.
    later = F.col("rep").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("rep"))) & (F.col("n_bytes") >= LENGTH)
    return of_key.select(
        "doc_id", "n_bytes", F.when(later, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(later, 1).otherwise(F.col("n_spans")).cast("long").alias("n_spans"), F.when(later, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
