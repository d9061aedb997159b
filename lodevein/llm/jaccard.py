"""N-gram Jaccard join: a size-aware heavy-light set similarity join with an exact result.

The set of a document is its distinct word n-grams (``gram`` words, four unless told otherwise).  Documents of one text are one class.  Sets up to a boundary are
light: for each size that a partner of theirs can ask of the intersection, they enumerate all their subsets of that size.
Larger sets are heavy: they scan inverted lists, of which the rarest ``size - ceil(t size) + 1`` tokens suffice, in an
order by exact document frequency; tokens of a single document come first and have no list, so a document
without near copies drops out at once.  The boundary is the one of least cost, from the histogram of sizes and the
mean length of lists; sets that can match over the boundary do both.

Documents that share a subset or a list are candidates.  Each is first compared with one pivot of its lists, and all that link
are merged.  Lists that still hold several components are then searched with a row of bits for each set: two sets of one
list stay candidates only if their sizes, the places of the list's token in them and their bits (whose differences count
differing tokens from below) leave room for enough common tokens.  What isn't of the largest component of its list asks
for its best candidate over all lists, whole sets verify these pairs, links are merged, and so on, until all that is left
was refuted.  If a document has several candidates left and nothing merges any more, the whole sets of what is open
are compared in blocks.  Nothing is lost on that way, and pairs of a group are never listed.

Defined results: a null or wordless text has 0 shingles and links with nothing; fewer than ``gram`` words are one
shingle; rows that repeat an id are documents of their own with that id, linked if their texts are; a null id has 0 shingles and a
null component; very long texts are read whole, and their bits grow with them; ids must be numbers that fit a long; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodevein.llm import blocks as B
from lodevein.llm.common import discard, settle
from lodevein.llm.graph import components
from lodevein.llm.words import word_hashes

GRAM = 4
#: Threshold as a fraction: 100 * intersection >= 85 * union; a caller may give another gram and numerator.
TOP, BOTTOM = 85, 100
#: Sizes from here on are one class of the histogram; their subsets are beyond any cost.
LARGE = 256
#: Members that meet in one comparison, and followers of a pivot in one task.
CHUNK = 512
GROUP = 2048
PIVOTS = 2
#: Edges that the driver merges at once, a megabyte of them; more are contracted in rounds of jobs first.
FEW_EDGES = 1 << 16
#: Least and most binary logarithm of the bits of a set.
BITS = (9, 16)

_GRAM = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def least_overlap(size: int, top: int = TOP) -> int:
    """Tokens that any partner must share with a set of that size."""
    return -(-top * size // BOTTOM)


def shingle_sets(row: dict, gram: int = GRAM) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a block."""
    starts, raw = B.unpack(row)
    w, at = word_hashes(raw, starts)
    mixed = np.zeros(max(0, len(w) - gram + 1), np.uint64)
    for k in range(gram):
        mixed += w[k : k + len(mixed)] * _GRAM[k]
    mixed = B.mix(mixed)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= gram:
            out.append(np.unique(mixed[a : b - gram + 1]))
        else:
            h = np.array([b - a][: b - a], np.uint64)
            for i in range(a, b):
                h = B.mix(h * _GRAM[0] + w[i : i + 1])
            out.append(h)
    return out


def light_rows(size: int, top: int = TOP) -> int:
    """Subsets that a light set of that size enumerates."""
    return sum(comb(size, k) for k in range(size - least_overlap(size, top) + 1))


def heavy_rows(size: int, top: int = TOP) -> int:
    return size - least_overlap(size, top) + 1


def boundary(histogram: dict[int, int], list_length: float, top: int = TOP) -> int:
    """The largest size of a light set, by least cost: subsets to enumerate against lists to scan."""
    heavy = lambda s, n: n * heavy_rows(s, top) * (1 + list_length)
    light, rest = 0, sum(heavy(s, n) for s, n in histogram.items())
    best = (rest, 0)
    for s in sorted(histogram):
        light, rest = light + histogram[s] * light_rows(s, top), rest - heavy(s, histogram[s])
        if light > best[0] or s >= LARGE:  # larger boundaries enumerate more
            break
        best = min(best, (light + rest, s))
    return best[1]


def signatures(tokens: np.ndarray, codes: np.ndarray, light: int, top: int = TOP) -> list[tuple[int, int]]:
    """Subsets and list tokens of a set, with how many of its tokens come before; codes are its tokens' document frequencies."""
    s = len(tokens)
    spare = s - least_overlap(s, top)
    order = np.lexsort((tokens, codes))
    shared = order[codes[order] > 0]
    alone = s - len(shared)
    if alone > spare:  # no partner can share enough
        return []
    out: dict[int, int] = {}
    if s > light or s >= least_overlap(light + 1, top):
        lists = tokens[shared[: spare + 1 - alone]].view(np.int64).tolist()
        out = dict(zip(lists, range(alone, alone + len(lists)), strict=True))
    if s <= light:
        whole = np.add.reduce(B.mix(tokens[shared]))
        for k in range(spare - alone + 1):
            picks = combinations(range(len(shared)), k)
            left = np.array([np.add.reduce(B.mix(tokens[shared[list(p)]])) if p else np.uint64(0) for p in picks], np.uint64)
            out |= dict.fromkeys(B.mix(whole - left + np.uint64(len(shared) - k)).view(np.int64).tolist(), 0)
    return sorted(out.items())


def bits_of(tokens: np.ndarray, size: int) -> bytes:
    """Whether each class of a set's tokens has an odd number; the classes grow with the size of the set."""
    width = 1 << min(max(BITS[0], (size - 1).bit_length()), BITS[1])
    odd = np.bincount((tokens >> np.uint64(8)).astype(np.int64) & (width - 1), minlength=width) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _shared(a: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of set a with each of the sets."""
    ends = np.cumsum([len(x) for x in sets])
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(a, flat), len(a) - 1)
    return np.add.reduceat((a[at] == flat).astype(np.int64), np.concatenate([[0], ends[:-1]]))


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two short lists of sets, as a product of 0-1 matrices in slices."""
    flat, seen = np.unique(np.concatenate(left + right), return_inverse=True)
    rows_ = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in left + right])
    counts = np.bincount(seen)
    use = np.cumsum(counts > 1) - 1
    keep = counts[seen] > 1
    seen, rows_ = use[seen[keep]], rows_[keep]
    out = np.zeros((len(left), len(right)), np.float32)
    width = int((counts > 1).sum())
    order = np.argsort(seen, kind="stable")
    seen, rows_ = seen[order], rows_[order]
    for lo in range(0, width, 8192):
        a, b = np.searchsorted(seen, [lo, lo + 8192])
        m = np.zeros((len(left) + len(right), min(8192, width - lo)), np.float32)
        m[rows_[a:b], seen[a:b] - lo] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out.astype(np.int64)


def _links(both: np.ndarray, a: np.ndarray | int, b: np.ndarray, top: int = TOP) -> np.ndarray:
    return (both > 0) & (BOTTOM * both >= top * (a + b - both))


def _root(up: list[int], i: int) -> int:
    while up[i] != i:
        up[i] = up[up[i]]
        i = up[i]
    return i


def _folded(bits: list[bytes], widths: np.ndarray, w: int) -> np.ndarray:
    """Rows of w words for all sets that have as many; those that have more are folded."""
    out = np.zeros((len(bits), w), np.uint64)
    for v in np.unique(widths[widths >= w]):
        own = np.flatnonzero(widths == v)
        out[own] = np.bitwise_xor.reduce(np.frombuffer(b"".join(bits[k] for k in own), np.uint64).reshape(len(own), v // w, w), axis=1)
    return out


def room(comp: np.ndarray, size: np.ndarray, alone: np.ndarray, place: np.ndarray, bits: list[bytes], left: np.ndarray, right: np.ndarray, top: int = TOP) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of left and right members of a list, of different components, that may link; with a bound of their common tokens."""
    rest = size - place
    widths = np.array([len(b) // 8 for b in bits])
    words: dict[int, np.ndarray] = {}
    strip = max(1, (1 << 20) // max(1, len(right)))
    for s in range(0, len(left), strip):
        own = left[s : s + strip]
        i, j = np.nonzero((comp[own, None] != comp[right]) & (BOTTOM * size[right] >= top * size[own, None]) & (BOTTOM * size[own, None] >= top * size[right]))
        i, j = own[i], right[j]
        both = size[i] + size[j]
        need = -(-top * both // (BOTTOM + top))
        keep = np.minimum(rest[i], rest[j]) >= need
        i, j, both, need = i[keep], j[keep], both[keep], need[keep]
        differ = alone[i] + alone[j]  # tokens that the other can't have, and bits that tell two sets apart
        narrow = np.minimum(widths[i], widths[j])
        for w in np.unique(narrow).tolist():
            if w not in words:
                words[w] = _folded(bits, widths, w)
            pairs = np.flatnonzero(narrow == w)
            for a in range(0, len(pairs), step := max(1, (1 << 21) // w)):
                k = pairs[a : a + step]
                differ[k] += np.bitwise_count(words[w][i[k]] ^ words[w][j[k]]).sum(1, dtype=np.int64)
        most = (both - differ) // 2
        keep = most >= need
        yield i[keep], j[keep], most[keep]


def _numbers(group: pa.Table, *names: str) -> list[np.ndarray]:
    return [group.column(c).to_numpy(zero_copy_only=False) for c in names]


def join_classes(docs: DataFrame, gram: int = GRAM, top: int = TOP) -> tuple[DataFrame, DataFrame]:
    """(key, rep, n_shingles) of every text, and edges (a, b) between reps that span the components of all links.

    docs(key, doc_id, text) holds each text once; rep is its number.
    """
    if not 0 < gram <= len(_GRAM):
        raise ValueError(f"grams have 1 to {len(_GRAM)} words")
    packed = B.pack(docs)
    codes = B.frequency_codes(packed, partial(shingle_sets, gram=gram))
    coded = packed.join(codes, "block", "left")

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in B.rows(batches):
            sets = shingle_sets(row, gram)
            tokens = np.unique(np.concatenate(sets)) if sets else np.array([], np.uint64)
            code = B.codes_of(row)
            out: list[tuple] = []
            for key, i, t in zip(row["keys"], row["numbers"], sets, strict=True):
                c = code[np.searchsorted(tokens, t)]
                shared = t[c > 0]
                # Whether any partner can share enough: all that later steps need of the others is their size.
                if not len(t) or len(shared) < least_overlap(len(t), top):
                    out.append((key, i, len(t), None, None, None, None))
                    continue
                c = c[c > 0]
                lists = float((0.5 ** ((c.astype(np.float64) - 1) / 2)).sum())  # this document's part of the number of lists
                out.append((key, i, len(t), shared.tobytes(), c.tobytes(), lists, bits_of(shared, len(t))))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.float64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], ["key", "rep", "size", "tokens", "codes", "lists", "bits"])

    found = settle(coded.mapInArrow(sized, "key binary, rep long, size long, tokens binary, codes binary, lists double, bits binary"))
    B.release()
    discard(packed, codes)
    near = found.filter("tokens is not null")
    histogram = {r["s"]: r["count"] for r in near.groupBy(F.least("size", F.lit(LARGE)).cast("int").alias("s")).count().collect()}
    entries, lists = near.agg(F.coalesce(F.sum(F.length("codes")), F.lit(0)), F.coalesce(F.sum("lists"), F.lit(0.0))).first()
    light = boundary(histogram, entries / max(1.0, lists), top)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            marks = []
            for n, t, c in zip(*(b.column(k).to_pylist() for k in ("size", "tokens", "codes")), strict=True):
                t, c = np.frombuffer(t, np.uint64), np.frombuffer(c, np.uint8)
                alone = n - len(t)
                # Tokens of this document alone stand before all others in the order.
                full = np.concatenate([np.zeros(alone, np.uint64), t]), np.concatenate([np.zeros(alone, np.uint8), c])
                marks.append([{"sig": s, "place": p} for s, p in signatures(*full, light, top)])
            yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(marks, pa.list_(pa.struct([("sig", pa.int64()), ("place", pa.int64())])))], ["rep", "sigs"])

    signs = near.select("rep", "size", "tokens", "codes").mapInArrow(signed, "rep long, sigs array<struct<sig: long, place: long>>")
    posts = signs.select("rep", F.explode("sigs").alias("s")).select("rep", "s.sig", "s.place")
    posts = settle(posts.join(posts.groupBy("sig").agg(F.count("*").alias("n")).filter("n > 1").select("sig"), "sig"))
    edges = _links_of(posts, near.select("rep", "size", "tokens"), near.select("rep", "size", (F.col("size") - F.length("tokens") / 8).cast("long").alias("alone"), "bits"), top)
    return found.select("key", "rep", F.col("size").alias("n_shingles")), edges


def _with_components(posts: DataFrame, edges: DataFrame) -> DataFrame:
    linked = components(edges, FEW_EDGES).withColumnRenamed("node", "rep")
    B.release()
    return settle(posts.join(linked, "rep", "left").select("sig", "rep", "place", F.coalesce("component", "rep").alias("comp")))


def _links_of(posts: DataFrame, sets: DataFrame, marks: DataFrame, top: int) -> DataFrame:
    """Edges that span the components of all links, from posts(sig, rep, place), sets(rep, size, tokens) and marks(rep, size, alone, bits)."""
    now = posts.select("sig", "rep", "place", F.col("rep").alias("comp"))
    edges, asking = None, None
    for turn in range(PIVOTS):
        found = _pivot_links(now, sets, turn, top)
        edges = settle(found if edges is None else edges.union(found))
        now = _with_components(posts, edges)
    while True:
        open_ = _open_lists(now, marks, top, asking)
        found = settle(_candidates(open_, top))
        asked = settle(found.groupBy("a").agg(F.max_by("b", F.struct("score", "b")).alias("b"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))
        hits = settle(_verified(asked, sets, top))
        done = asked.filter("lo < hi").isEmpty()  # every document had one candidate at most, which was verified
        if hits.isEmpty():
            return edges if done else edges.union(settle(_compared(open_, sets, top)))
        edges = settle(edges.union(hits))
        discard(open_)
        if done:
            return edges
        # Merging takes candidates away and brings none, so lists without any are closed, and who had none has no more to ask.
        asking = found.select("sig", F.col("a").alias("rep"))
        posts = settle(posts.join(found.select("sig").distinct(), "sig", "left_semi"))
        now = _with_components(posts, edges)


def _pivot_links(now: DataFrame, sets: DataFrame, turn: int, top: int) -> DataFrame:
    """Links of documents with one other document of their lists, which most of those lists have as theirs."""

    def star(group: pa.Table) -> pa.Table:
        ids, size = _numbers(group, "rep", "size")
        pivot = group.column("pivot")[0].as_py()
        own = [np.frombuffer(t, np.uint64) for t in group.column("tokens").to_pylist()]
        p = int(np.flatnonzero(ids == pivot)[0])
        hit = _links(_shared(own[p], own), size[p], size, top) & (ids != pivot)
        return pa.table({"a": np.full(int(hit.sum()), pivot), "b": ids[hit]})

    # The member of the least place has the fewest tokens of its own, so most of a group link with it; later turns try any other.
    at = F.struct("place" if not turn else F.lit(0).alias("place"), F.xxhash64("rep", F.lit(turn)))
    pivots = now.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min_by(F.struct("rep", "comp"), at).alias("p")).filter("lo < hi")
    votes = now.join(pivots, "sig").filter("comp != p.comp").groupBy("rep", F.col("p.rep").alias("pivot")).agg(F.count("*").alias("votes"))
    pairs = settle(votes.groupBy("rep").agg(F.max_by("pivot", F.struct("votes", "pivot")).alias("pivot")))
    parts = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts"))
    followers = pairs.join(parts, "pivot").select("pivot", F.pmod(F.xxhash64("rep"), F.col("parts").cast("long")).cast("int").alias("part"), "rep")
    leaders = parts.select("pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("pivot").alias("rep"))
    return followers.union(leaders).join(sets, "rep").groupBy("pivot", "part").applyInArrow(star, "a long, b long")


def _open_lists(now: DataFrame, marks: DataFrame, top: int, asking: DataFrame | None = None) -> DataFrame:
    """Members of the lists that hold several components, as (sig, band, i, j, asks, rep, comp, place, size, alone, bits).

    Lists of the same members are one; the first in the order of tokens stands for them.  What isn't of a list's largest
    component asks all its members, or just what is in asking(sig, rep).  Lists of over CHUNK members are cut into bands of
    sizes, of which only neighbours can link, and these into chunks; bands without anyone to ask or to be asked are left out.
    """
    half = F.xxhash64("rep")
    by_comp = now.groupBy("sig", "comp").agg(F.count("*").alias("n"), F.sum("place").alias("place"), F.sum(half.bitwiseAND(0x7FFFFFFF)).alias("x"), F.sum(F.shiftrightunsigned(half, 33)).alias("y"))
    lists = by_comp.groupBy("sig").agg(*[F.sum(c).alias(c) for c in ("n", "place", "x", "y")], F.max(F.struct("n", "comp")).alias("main")).filter("n > main.n")
    lists = settle(lists.groupBy("n", "x", "y").agg(F.min_by(F.struct("sig", F.col("main.comp").alias("main")), F.struct("place", "sig")).alias("s")).select("s.*", "n"))
    large = F.col("n") > CHUNK
    member = now.join(lists, "sig").join(marks.select("rep", "size", "alone"), "rep").withColumn("at", F.when(large, F.floor(F.log("size") / (log(BOTTOM / top) * (1 + 1e-9)))).otherwise(0).cast("int"))
    if asking is None:
        member = member.withColumn("wants", F.col("comp") != F.col("main"))
    else:
        member = member.join(asking.select("sig", "rep", F.lit(True).alias("wants")).distinct(), ["sig", "rep"], "left").withColumn("wants", F.col("wants").isNotNull())
    # Written without the bits, so that both readers below find it done; the bits come to what is left.
    member = settle(member.drop("main"))
    near = F.when(large, F.array(F.col("at") - 1, F.col("at"), F.col("at") + 1)).otherwise(F.array("at"))
    spot = lambda band, asks: F.struct(band.alias("band"), F.lit(asks).alias("asks"))
    spots = F.concat(F.when(F.col("wants"), F.transform(near, lambda band: spot(band, True))).otherwise(F.array()), F.array(spot(F.col("at"), False)))
    placed = member.withColumn("spot", F.explode(spots)).select("sig", "spot.*", "n", "rep", "comp", "place", "size", "alone")
    own = ("rep", "comp", "place", "size", "alone", "bits")
    counts = placed.filter(large).groupBy("sig", "band").agg(F.count_if("asks").alias("few"), F.count_if(~F.col("asks")).alias("all"))
    chunks = lambda c: F.greatest(F.lit(1), F.ceil(F.coalesce(c, F.lit(1)) / CHUNK)).cast("int")
    placed = placed.join(counts, ["sig", "band"], "left").filter(~large | (F.col("few") > 0) & (F.col("all") > 0)).join(marks.select("rep", "bits"), "rep")
    mine = lambda n: F.pmod(F.xxhash64("rep"), n.cast("long")).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    few, all_ = chunks(F.col("few")), chunks(F.col("all"))
    one: Column = F.when(F.col("asks"), F.transform(every(all_), lambda j: F.struct(mine(few).alias("i"), j.alias("j")))).otherwise(F.transform(every(few), lambda i: F.struct(i.alias("i"), mine(all_).alias("j"))))
    out = placed.select("sig", "band", F.explode(one).alias("c"), "asks", *own).select("sig", "band", "c.i", "c.j", "asks", *own)
    out.settled_at = member.settled_at  # for discard()
    return out


_BLOCK = ["sig", "band", "i", "j"]


def _pairs_with_room(group: pa.Table, top: int) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Members of a block in order of id, and its candidate pairs."""
    asks, rep, comp, place, size, alone = _numbers(group, "asks", "rep", "comp", "place", "size", "alone")
    return rep, room(comp, size, alone, place, group.column("bits").to_pylist(), np.flatnonzero(asks), np.flatnonzero(~asks), top)


def _candidates(open_: DataFrame, top: int) -> DataFrame:
    """sig, a, b, score, lo, hi: for every document with candidates in a list the one that may have most in common, and the first and last of all."""

    def best(group: pa.Table) -> pa.Table:
        rep, pairs = _pairs_with_room(group, top)
        size = group.column("size").to_numpy()
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        for i, j, most in pairs:
            if not len(i):
                continue
            score = most / (size[i] + size[j] - most)
            order = np.lexsort((rep[j], -score, i))
            starts = np.flatnonzero(np.diff(i[order], prepend=-1))
            i, j, score = i[order], j[order], score[order]
            for column, x in zip(out, (rep[i[starts]], rep[j[starts]], score[starts], np.minimum.reduceat(rep[j], starts), np.maximum.reduceat(rep[j], starts)), strict=True):
                column.append(x)
        kinds = (np.int64, np.int64, np.float64, np.int64, np.int64)
        a, b, score, lo, hi = (np.concatenate([np.array([], kind), *x]) for x, kind in zip(out, kinds, strict=True))
        return pa.table({"sig": np.full(len(a), group.column("sig")[0].as_py()), "a": a, "b": b, "score": score, "lo": lo, "hi": hi})

    return open_.groupBy(*_BLOCK).applyInArrow(best, "sig long, a long, b long, score double, lo long, hi long")


def _verified(asked: DataFrame, sets: DataFrame, top: int) -> DataFrame:
    """The pairs (a, b) that link."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y, m, n in zip(*(b.column(c).to_pylist() for c in ("x", "y", "m", "n")), strict=True):
                both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                keep.append(both > 0 and BOTTOM * both >= top * (m + n - both))
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    one = asked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    x = sets.select(F.col("rep").alias("a"), F.col("size").alias("m"), F.col("tokens").alias("x"))
    y = sets.select(F.col("rep").alias("b"), F.col("size").alias("n"), F.col("tokens").alias("y"))
    return one.join(x, "a").join(y, "b").mapInArrow(check, "a long, b long")


def _compared(open_: DataFrame, sets: DataFrame, top: int) -> DataFrame:
    """A forest over the components that links join, from the whole sets of all that still have candidates in a block."""

    def wanted(group: pa.Table) -> pa.Table:
        use = np.zeros(len(group), bool)
        for i, j, _ in _pairs_with_room(group, top)[1]:
            use[i] = use[j] = True
        return group.select([*_BLOCK, "asks", "rep", "comp"]).filter(pa.array(use))

    def rest(group: pa.Table) -> pa.Table:
        comp, size, asks = _numbers(group, "comp", "size", "asks")
        own = [np.frombuffer(t, np.uint64) for t in group.column("tokens").to_pylist()]
        names, index = np.unique(comp, return_inverse=True)
        up = list(range(len(names)))
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
        for s in range(0, len(left), 256):
            for e in range(0, len(right), 256):
                i, j = left[s : s + 256], right[e : e + 256]
                hit = (comp[i, None] != comp[None, j]) & _links(_overlaps([own[k] for k in i], [own[k] for k in j]), size[i, None], size[None, j], top)
                for x, y in np.unique(np.stack([index[i[np.nonzero(hit)[0]]], index[j[np.nonzero(hit)[1]]]], 1), axis=0).tolist():
                    x, y = _root(up, x), _root(up, y)
                    up[max(x, y)] = min(x, y)
        root = np.array([_root(up, k) for k in range(len(up))])
        moved = root != np.arange(len(up))
        return pa.table({"a": names[moved], "b": names[root[moved]]})

    todo = settle(open_.groupBy(*_BLOCK).applyInArrow(wanted, "sig long, band int, i int, j int, asks boolean, rep long, comp long"))
    return todo.join(sets, "rep").groupBy(*_BLOCK).applyInArrow(rest, "a long, b long").distinct()


def linked_texts(docs: DataFrame, gram: int = GRAM, top: int = TOP) -> tuple[DataFrame, DataFrame]:
    """member(doc_id, key) of every row, and (key, rep, n_shingles, c) of every text that has an id: its smallest id, the size of its set and the number of its component."""
    member, groups, once = B.distinct_texts(docs)
    sizes, edges = join_classes(once.filter("doc_id is not null"), gram, top)
    linked = components(edges, FEW_EDGES)
    numbered = sizes.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("key", "n_shingles", F.coalesce("component", "rep").alias("c"))
    return member, settle(groups.filter("rep is not null").join(numbered, "key"))


def similar_documents(docs: DataFrame, gram: int = GRAM, top: int = TOP) -> DataFrame:
    """doc_id, n_shingles, component_id for every document; links have ``top`` hundredths of the union of ``gram`` words in common."""
    member, known = linked_texts(docs, gram, top)
    firsts = known.groupBy("c").agg(F.min("rep").alias("first"))
    joined = member.join(known.join(firsts, "c").select("key", "n_shingles", "first"), "key", "left")
    size = F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("n_shingles", F.lit(0))).cast("long")
    return joined.select("doc_id", size.alias("n_shingles"), F.when(size > 0, F.col("first")).otherwise(F.col("doc_id")).alias("component_id"))


def spare_documents(docs: DataFrame, gram: int = GRAM, top: int = TOP) -> tuple[DataFrame, DataFrame]:
    """Rows that a corpus of one document for each component can do without, as pairs of id and sha-256 of the text: gone(doc_id, key) go as a whole, of again(doc_id, key) one row stays.

    The row of the smallest id stays, of equal ids the one of the smallest digest.  An id alone doesn't name a row: other texts that bear it stay.
    """
    member, known = linked_texts(docs, gram, top)
    full = known.filter("n_shingles > 0")
    first = full.groupBy("c").agg(F.min(F.struct("rep", "key")).alias("first"))
    named = member.filter("doc_id is not null").join(full.join(first, "c").select("key", "first"), "key")
    rows = settle(named.groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.first("first").alias("first")))
    stays = (F.col("doc_id") == F.col("first.rep")) & (F.col("key") == F.col("first.key"))
    return rows.filter(~stays).select("doc_id", "key"), rows.filter(stays & (F.col("n") > 1)).select("doc_id", "key")
