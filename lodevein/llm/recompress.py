"""Substring dedup by recompression: remove words that a window of 20 words covers which also starts earlier.

Texts are sequences of words, and rounds make them shorter: runs of one symbol become one symbol, then neighbours become one
wherever the left one is of one half of the alphabet and the right one of the other.  A symbol's name is made
of its parts alone, so names are the same in the whole corpus, and which symbols an inner stretch of text turns into depends
on that stretch and not on what is around it.  From the ends of a window fall, in each round, just the symbols that its
surroundings could change: what is left is the same in all equal windows.

After a few rounds Spark counts the names over the whole corpus.  A window in which any symbol is left that occurs once can't repeat
and is out; texts without open windows are done and leave.  After the last round the longest symbol left is the anchor of
its window (the highest level that a window has symbols on decides).  Neighbouring windows of one anchor are a string of words, which
goes, once for each block, to the bucket of the anchor's name.  There shared anchors are verified by the words themselves:
equal words get one number, then equal runs of 2, 4, 8 and 16 words, then equal windows.  Nothing rests on equal hashes.
Windows of anchors in 2,048 places or more go one by one, by a hash of themselves, to be verified in the same way, so that no
common phrase gathers its surroundings in one task.

Defined results: a null text has no words; rows of one id aren't earlier than each other, but equal windows of one text are; a null id comes after
all others and isn't earlier than another null id; texts are read whole, however long; an empty table gives an empty result; further columns are ignored.
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
from lodevein.llm.words import word_hashes, word_spans

LENGTH = 20
#: Rounds of pairs after which Spark counts names; runs are named in the first one.
COUNTED = (2, 4)
#: Code of frequency (1 + 2 log2 n) from which windows go one by one: 2,048 places.
HOT_CODE = 23
#: Windows of a string at most.
RUN = 64
NULL_ID = np.iinfo(np.int64).max

_RUN, _LEFT, _RIGHT, _LEVEL, _STEP = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x9E3779B97F4A7C15))


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1 and so on, ``size`` of them, for each pair one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


def first_least(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Where the least key of each range lies; the first of equal ones."""
    out = np.empty(len(lo), np.int64)
    better = lambda a, b: np.where(key[b] < key[a], b, a)
    power = np.frexp((hi - lo).astype(np.float64))[1] - 1
    at = np.arange(len(key))
    for j in range(int(power.max(initial=-1)) + 1):
        if j:
            half = 1 << (j - 1)
            at = better(at[:-half], at[half:])
        own = np.flatnonzero(power == j)
        out[own] = better(at[lo[own]], at[hi[own] - (1 << j)])
    return out


class Parse:
    """A block's texts as symbols, round by round, and what is left of their open windows.

    Symbols have a name, a width in words and the place of their first word; ``lo`` and ``hi`` bound the symbols left of
    window ``todo[i]``, which starts at word ``start[todo[i]]``.
    """

    def __init__(self, row: dict, length: int = LENGTH) -> None:
        starts, raw = B.unpack(row)
        self.name, self.texts = word_hashes(raw, starts, fold=False)
        self.words, self.length, self.turn = self.name, length, 0
        n = len(self.name)
        self.head = np.zeros(n + 1, bool)
        self.head[self.texts[:-1]] = True
        self.head = self.head[:n]
        self.width, self.first, self.fresh = np.ones(n, np.int64), np.arange(n), np.zeros(n, bool)
        self.start = ranges(self.texts[:-1], np.maximum(0, np.diff(self.texts) - length + 1))
        if row.get("open") is not None:  # what earlier counts left
            flags = np.unpackbits(np.frombuffer(row["open"], np.uint8), count=len(self.start)).astype(bool)
            self.start = self.start[flags]
        self.todo = np.arange(len(self.start))
        self.lo, self.hi = self.start.copy(), self.start + length
        self.open = np.ones(len(self.start), bool)
        self.anchor, self.spot = np.zeros(len(self.start), np.uint64), np.zeros(len(self.start), np.int64)

    def _narrow(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Windows without symbols left after a step get their anchor from before it; says which go on."""
        on = lo < hi
        self.close(~on)
        self.todo = self.todo[on]
        return on

    def close(self, which: np.ndarray) -> None:
        """The widest symbol left of these windows, of equal ones the one of the least name, is their anchor."""
        if not which.any():
            return
        wide = np.minimum(self.width, 63).astype(np.uint64)
        key = ((np.uint64(63) - wide) << np.uint64(58)) | (self.name >> np.uint64(6))
        at = first_least(key, self.lo[which], self.hi[which])
        own = self.todo[which]
        self.anchor[own] = B.mix(self.name[at] + np.full(1, self.turn + 1, np.uint64) * _LEVEL)
        self.spot[own] = self.first[at] * 64 + self.turn

    def _contract(self, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that begin anew stay, the others join the one before: where the new ones begin, and to which each belongs."""
        begin = np.flatnonzero(new)
        self.width = np.add.reduceat(self.width, begin) if len(begin) else self.width
        self.head, self.first = self.head[begin], self.first[begin]
        return begin, np.cumsum(new) - 1

    def runs(self) -> None:
        """Equal neighbours become one symbol; the first and last run of a window may go on outside."""
        name = self.name
        new = self.head.copy()
        new[1:] |= name[1:] != name[:-1]
        of = np.cumsum(new) - 1
        lo, hi = of[self.lo] + 1, of[self.hi - 1]
        on = self._narrow(lo, hi)
        self.lo, self.hi = lo[on], hi[on]
        begin, _ = self._contract(new)
        k = np.diff(np.append(begin, len(name))).astype(np.uint64)
        self.name = np.where(k > 1, B.mix(name[begin] * _RUN + k), name[begin])
        self.fresh = self.fresh[begin] | (k > 1)
        self.turn += 1

    def pairs(self) -> None:
        """A bit of the name tells left symbols from right ones; a right one first in a window, or a left one last, may join what is outside."""
        name = self.name
        left = (name >> np.uint64(self.turn)) & np.uint64(1) == 0
        joins = left[:-1] & ~left[1:] & ~self.head[1:]
        new = np.ones(len(name), bool)
        new[1:] = ~joins
        lo, hi = self.lo + ~left[self.lo], self.hi - left[self.hi - 1]
        on = self._narrow(lo, hi)
        lo, hi = lo[on], hi[on]
        begin, of = self._contract(new)
        self.lo, self.hi = of[lo], of[hi - 1] + 1
        at = np.flatnonzero(joins)
        self.name = name[begin]
        self.name[of[at]] = B.mix(name[at] * _LEFT + name[at + 1] * _RIGHT)
        self.fresh = self.fresh[begin]
        self.fresh[of[at]] = True
        self.turn += 1

    def upto(self, pairs: int) -> None:
        """Rounds until there were so many of pairs."""
        if not self.turn:
            self.runs()
        while self.turn <= pairs:
            self.pairs()

    def left(self) -> np.ndarray:
        """Symbols that are left of some window."""
        n = len(self.name)
        return np.cumsum(np.bincount(self.lo, minlength=n + 1) - np.bincount(self.hi, minlength=n + 1))[:n] > 0

    def drop(self, alone: np.ndarray) -> None:
        """Windows of which a symbol is left that is marked can't repeat."""
        before = np.concatenate([[0], np.cumsum(alone)])
        self.open[self.todo[before[self.hi] > before[self.lo]]] = False

    def spots(self) -> np.ndarray:
        """The names of all anchors, one for each place."""
        _, at = np.unique(self.spot, return_index=True)
        return self.anchor[at]


def parsed(row: dict, length: int, k: int) -> tuple[Parse, np.ndarray, np.ndarray]:
    """A block before count ``k``, which of its symbols are counted, and the names that are; the last count is that of anchors, too."""
    p = Parse(row, length)
    for before in COUNTED[:k]:
        p.upto(before)
        p.fresh[:] = False
    p.upto(COUNTED[k])
    counted = p.left() & p.fresh
    names = p.name[counted]
    if k == len(COUNTED) - 1:
        p.close(np.ones(len(p.todo), bool))
        names = np.concatenate([names, p.spots()])
    return p, counted, names


def counted_apart(row: dict, length: int, k: int) -> tuple[Parse, np.ndarray, np.ndarray]:
    """The block with windows closed that hold a symbol without another; and the codes of the names, with these."""
    p, counted, names = parsed(row, length, k)
    known = np.unique(names)
    code = B.codes_of(row)
    alone = np.zeros(len(p.name), bool)
    alone[counted] = code[np.searchsorted(known, p.name[counted])] == 0
    p.drop(alone)
    return p, known, code


def normal(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with a space behind each, and where each begins (one entry more than words)."""
    size = ends - begins + 1
    at = np.concatenate([[0], np.cumsum(size)])
    out = raw[np.minimum(ranges(begins, size), len(raw) - 1)]
    out[at[1:] - 1] = 32
    return out, at


def _texts(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's words as ``normal`` gives them, and where each text's begin."""
    starts, raw = B.unpack(row)
    begins, ends = word_spans(raw, starts)
    return *normal(raw, begins, ends), np.searchsorted(begins, starts)


_DONE = pa.list_(pa.struct([("key", pa.binary()), ("n_words", pa.int64()), ("sha", pa.string())]))
_DONE_SQL = "done array<struct<key: binary, n_words: long, sha: string>>"


def _done(row: dict, keep: np.ndarray) -> list[dict]:
    """Results of the texts that have no open windows."""
    words, at, of = _texts(row)
    out = []
    for k in np.flatnonzero(~keep).tolist():
        a, b = of[k], of[k + 1]
        out.append({"key": row["keys"][k], "n_words": int(b - a), "sha": hashlib.sha256(words[at[a] : max(at[a], at[b] - 1)].tobytes()).hexdigest()})
    return out


def _with_open_windows(blocks: DataFrame, codes: DataFrame, length: int, k: int) -> DataFrame:
    """Blocks after count ``k``: texts that have open windows stay, with a bit for each window; ``done`` has the others."""

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.rows(batches):
            p, _, _ = counted_apart(row, length, k)
            flags = np.zeros(len(p.words) + 1, bool)
            flags[p.start[p.open]] = True
            held = np.concatenate([[0], np.cumsum(flags)])
            keep = held[p.texts[1:]] > held[p.texts[:-1]]
            kept = np.flatnonzero(keep)
            starts, raw = B.unpack(row)
            windows = ranges(p.texts[:-1][keep], np.maximum(0, np.diff(p.texts) - length + 1)[keep])
            size = np.diff(starts)[keep]
            pick = lambda c: [row[c][i] for i in kept.tolist()]  # noqa: E731,B023
            out = B.block_row(row["block"], np.array(row["numbers"], np.int64)[keep], pick("ids"), pick("keys"), np.cumsum(size), raw[ranges(starts[:-1][keep], size)].tobytes())
            more = [pa.array([np.packbits(flags[windows]).tobytes()], pa.binary()), pa.array([_done(row, keep)], _DONE)]
            yield pa.RecordBatch.from_arrays([*out.columns, *more], [*out.schema.names, "open", "done"])

    return settle(blocks.join(codes, "block", "left").mapInArrow(prune, f"{B.BLOCK}, open binary, {_DONE_SQL}"))


_SENT = {"bucket": pa.int32(), "block": pa.string(), "names": pa.binary(), "sizes": pa.binary(), "ids": pa.binary(), "texts": pa.binary(), "starts": pa.binary(), "data": pa.binary()}
_LAYOUT = {"first": pa.binary(), "count": pa.binary(), "place": pa.binary(), "sent": pa.binary()}
_SENT_SQL = "bucket int, block string, names binary, sizes binary, ids binary, texts binary, starts binary, data binary"
_LAYOUT_SQL = "first binary, count binary, place binary, sent binary"


def strings_of(p: Parse, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and name of the strings of a block's open windows; windows of hot anchors are strings of their own."""
    own = np.flatnonzero(p.open)
    start, spot, hot = p.start[own], p.spot[own], hot[own]
    new = np.ones(len(own), bool)
    new[1:] = (start[1:] != start[:-1] + 1) | (spot[1:] != spot[:-1]) | hot[1:] | hot[:-1]
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(own)))
    if len(n) and n.max() > RUN:
        times = -(-n // RUN)
        part = ranges(np.zeros(len(n), np.int64), times) * RUN
        at, n = np.repeat(at, times) + part, np.minimum(np.repeat(n, times) - part, RUN)
    name = p.anchor[own][at]
    of_hot = np.flatnonzero(hot[at])
    h = np.zeros(len(of_hot), np.uint64)
    for k in range(p.length):
        h = (h + p.words[start[at[of_hot]] + k]) * _STEP
    name[of_hot] = B.mix(name[of_hot] ^ h)
    return start[at], n, name


def _cut(blocks: DataFrame, codes: DataFrame, length: int, hot_code: int, buckets: int) -> DataFrame:
    """Rows of two kinds: what a bucket gets of a block, and, of bucket -1, the block with the layout of its strings."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.rows(batches):
            p, known, code = counted_apart(row, length, len(COUNTED) - 1)
            of_anchor = code[np.searchsorted(known, p.anchor)] if len(known) else np.zeros(len(p.anchor), np.uint8)
            p.open &= of_anchor > 0
            first, count, name = strings_of(p, of_anchor >= hot_code)
            words, at, texts = _texts(row)
            text = np.searchsorted(texts, first, "right") - 1
            ids = np.array([NULL_ID if i is None else i for i in row["ids"]], np.int64)
            size = count + length - 1
            blobs = [words[a:b].tobytes() for a, b in zip(at[first].tolist(), (at[first + size] - 1).tolist(), strict=True)]
            # Each string goes once, from the first of its texts; what comes later in this block is known to.
            place, sent, of = np.full(len(first), -1, np.int32), [], name.tolist()
            earliest: dict[tuple, tuple] = {}
            for s in np.lexsort((first, text, ids[text])).tolist():
                i, t = ids[text[s]], int(text[s])
                had = earliest.setdefault((of[s], blobs[s]), (i, t, s))
                if had[2] != s:
                    # Another text of the same id isn't later, so its first string goes, too.
                    if had[0] < i or had[1] == t or earliest.setdefault((of[s], blobs[s], t), (i, t, s))[2] != s:
                        continue
                place[s] = len(sent)
                sent.append(s)
            sent = np.array(sent, np.int64)
            bucket = (name[sent] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rank = np.empty(len(sent), np.int32)
            rank[order] = np.arange(len(sent))
            place[place >= 0] = rank[place[place >= 0]]
            sent, bucket = sent[order], bucket[order]
            edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(sent))
            out: dict[str, list] = {c: [] for c in (*_SENT, *_LAYOUT)}
            cells = {c: b"" for c in out}
            raw_of = lambda s: {"names": name[s].tobytes(), "sizes": size[s].astype(np.int16).tobytes(), "ids": ids[text[s]].tobytes(), "texts": text[s].astype(np.int32).tobytes(), "starts": first[s].astype(np.int32).tobytes(), "data": b"\n".join([blobs[x] for x in s.tolist()])}  # noqa: E731,B023
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                for c, v in {**cells, "bucket": int(bucket[a]), "block": row["block"], **raw_of(sent[a:b])}.items():
                    out[c].append(v)
            layout = {"first": first.astype(np.int32), "count": count.astype(np.int16), "place": place, "sent": count[sent].astype(np.int16)}
            for c, v in {**cells, "bucket": -1, "block": row["block"], **{x: y.tobytes() for x, y in layout.items()}}.items():
                out[c].append(v)
            kinds = {**_SENT, **_LAYOUT}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds[c]) for c, v in out.items()], list(out))

    return settle(blocks.join(codes, "block", "left").mapInArrow(cut, f"{_SENT_SQL}, {_LAYOUT_SQL}"))


def equal_windows(strings: list[bytes], length: int) -> np.ndarray:
    """A number for every window of each string of words, string after string; equal windows have equal numbers.

    Words are numbered, then runs of twice as many words by the numbers of their halves.
    """
    seen: dict[bytes, int] = {}
    split = [s.split(b" ") for s in strings]
    size = np.array([len(w) for w in split])
    flat = np.array([seen.setdefault(w, len(seen)) for words in split for w in words], np.int64)

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]

    have = 1
    while 2 * have <= length:
        flat, have = joined(flat[: len(flat) - have], flat[have:]), 2 * have
    rest = length - have
    flat = joined(flat[: len(flat) - rest], flat[rest:]) if rest else flat
    return flat[ranges(np.cumsum(size) - size, size - length + 1)]


def compare(group: pa.Table, length: int = LENGTH) -> pa.Table:
    """For each block of a bucket: which windows of its strings have an equal one that starts earlier."""
    cells = lambda c, t: np.frombuffer(b"".join(group.column(c).to_pylist()), t)
    name, size, ids, start = cells("names", np.uint64), cells("sizes", np.int16).astype(np.int64), cells("ids", np.int64), cells("starts", np.int32)
    lens = np.array([len(x) // 8 for x in group.column("names").to_pylist()])
    text = np.unique(np.repeat(np.arange(len(lens)), lens) * (1 << 32) + cells("texts", np.int32), return_inverse=True)[1]
    seen: dict[tuple[int, bytes], int] = {}
    data = [s for x in group.column("data") for s in x.as_py().split(b"\n")]
    of = np.array([seen.setdefault(x, len(seen)) for x in zip(name.tolist(), data, strict=True)], np.int64)
    only = [s for _, s in seen]
    own = np.array([n for n, _ in seen], np.uint64)
    windows = np.zeros(len(only), np.int64)
    windows[of] = size - length + 1
    at = np.cumsum(windows) - windows
    number = np.arange(windows.sum())
    # A string that alone has its anchor holds no window twice; the others are verified by their words.
    _, kind, times = np.unique(own, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times[kind] > 1)
    if len(shared):
        number[ranges(at[shared], windows[shared])] = len(number) + equal_windows([only[k] for k in shared.tolist()], length)
    n = windows[of]
    window = number[ranges(at[of], n)]
    of_string = np.repeat(np.arange(len(of)), n)
    begin = ranges(start.astype(np.int64), n)
    order = np.lexsort((begin, text[of_string], ids[of_string], window))
    w, i, t = window[order], ids[of_string][order], text[of_string][order]
    first = np.flatnonzero(np.diff(w, prepend=-1))
    least = np.repeat(i[first], np.diff(np.append(first, len(w))))
    again = np.zeros(len(w), bool)  # the same text had this window before
    again[1:] = (w[1:] == w[:-1]) & (t[1:] == t[:-1])
    gone = np.empty(len(w), bool)
    gone[order] = (i > least) | again
    ends = np.cumsum(n)[np.cumsum(lens) - 1]
    masks = [np.packbits(gone[a:b]).tobytes() for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)]
    return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "mask": pa.array(masks, pa.binary()), "n": pa.array(np.diff(ends, prepend=0), pa.int64())})


def _finish(blocks: DataFrame, length: int) -> DataFrame:
    """key, n_words, n_removed, kept_sha256 of the texts that had open windows."""

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.rows(batches):
            words, at, texts = _texts(row)
            first, count, place, sent = (np.frombuffer(row[c], t).astype(np.int64) for c, t in (("first", np.int32), ("count", np.int16), ("place", np.int32), ("sent", np.int16)))
            masks = [np.unpackbits(np.frombuffer(m["mask"], np.uint8), count=m["n"]) for m in row["masks"] or []]
            flags = np.concatenate([*masks, [1]]).astype(bool)  # the last one is of strings that a text of this block has before
            before = np.cumsum(sent) - sent
            within = ranges(np.zeros(len(count), np.int64), count)
            known = np.repeat(place < 0, count)
            spot = np.where(known, len(flags) - 1, np.repeat(before[np.maximum(place, 0)], count) + within)
            begin = (np.repeat(first, count) + within)[flags[spot]]
            n = len(at)
            gone = np.cumsum(np.bincount(begin, minlength=n) - np.bincount(begin + length, minlength=n))[: n - 1] > 0
            kept = words[np.repeat(~gone, np.diff(at))]
            left = np.concatenate([[0], np.cumsum(np.where(gone, 0, np.diff(at)))])
            removed = np.concatenate([[0], np.cumsum(gone)])
            a, b = texts[:-1], texts[1:]
            shas = [hashlib.sha256(kept[x : max(x, y - 1)].tobytes()).hexdigest() for x, y in zip(left[a].tolist(), left[b].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(row["keys"], pa.binary()), pa.array(b - a), pa.array(removed[b] - removed[a]), pa.array(shas, pa.string())], ["key", "n_words", "n_removed", "kept_sha256"])

    return blocks.mapInArrow(finish, "key binary, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot_code: int = HOT_CODE) -> DataFrame:
    """key, n_words, n_removed, kept_sha256 for docs(key, doc_id, text), each text once."""
    left, done = B.pack(docs), []
    buckets = max(64, B.text_bytes(left) >> 22)
    for k in range(len(COUNTED) - 1):
        codes = B.frequency_codes(left, lambda row, k=k: [parsed(row, length, k)[2]])
        newer = _with_open_windows(left, codes, length, k)
        B.release()
        discard(left, codes)
        done.append(newer.select(F.explode("done").alias("d")).select("d.key", "d.n_words", F.lit(0).cast("long").alias("n_removed"), F.col("d.sha").alias("kept_sha256")))
        left = newer.filter("size(ids) > 0")
        left.settled_at = newer.settled_at
    codes = B.frequency_codes(left, lambda row: [parsed(row, length, len(COUNTED) - 1)[2]])
    laid = _cut(left.drop("done"), codes, length, hot_code, buckets)
    sent = laid.filter("bucket >= 0").drop(*_LAYOUT)
    masks = sent.groupBy("bucket").applyInArrow(lambda g: compare(g, length), "block string, bucket int, mask binary, n long")
    masks = settle(masks.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "mask", "n"))).alias("masks")))
    B.release()
    layouts = laid.filter("bucket < 0").select("block", *_LAYOUT).join(masks, "block", "left")
    out = _finish(left.drop("done", "open").join(layouts, "block"), length)
    for d in done:
        out = out.unionByName(d)
    return out


def summary(docs: DataFrame, length: int = LENGTH, hot_code: int = HOT_CODE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document."""
    member, classes, once = B.distinct_texts(docs)
    of_key = member.join(classes, "key").join(settle(remove_repeats(once, length, hot_code)), "key")
    # A later copy is covered by the first as a whole, if it has a window at all.
    later = F.col("rep").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("rep"))) & (F.col("n_words") >= length)
    return of_key.select("doc_id", "n_words", F.when(later, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(later, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"))
