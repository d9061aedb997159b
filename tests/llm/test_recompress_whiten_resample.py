"""Recompression, whitening and resampling against brute force."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from lodevein.llm import recompress, resample, whitening
from tests.llm.data import frame, texts

WORD = re.compile("[^\x20\x09-\x0d]+")


def removed_brute(rows, length):
    """doc_id, n_words, n_removed, sha of (id, text) rows; a null id is last."""
    last = 1 << 62
    parts = [(last if i is None else i, WORD.findall(t or "")) for i, t in rows]
    first, own = {}, {}
    for k, (i, w) in enumerate(parts):
        for p in range(len(w) - length + 1):
            g = tuple(w[p : p + length])
            first[g] = min(first.get(g, i), i)
            own.setdefault((k, g), p)
    out = []
    for k, (i, w) in enumerate(parts):
        gone = [False] * len(w)
        for p in range(len(w) - length + 1):
            g = tuple(w[p : p + length])
            if first[g] < i or own[k, g] < p:
                gone[p : p + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((str(None if i == last else i), len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def removed(df, **more):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in recompress.summary(df, **more).collect())


@pytest.mark.parametrize("hot", [recompress.HOT_CODE, 3])
def test_recompression(spark, hot):
    df = frame(spark)
    assert removed(df, hot_code=hot) == removed_brute([(r["doc_id"], r["text"]) for r in df.collect()], 20)
    assert recompress.summary(frame(spark, [])).count() == 0


def odd_rows():
    """Shared passages at all offsets, runs, periods, repeats inside a text, ids that several texts have."""
    rng = np.random.default_rng(4)
    passages = [[f"p{k}_{rng.integers(40)}" for _ in range(int(rng.integers(18, 70)))] for k in range(6)]
    rows = []
    for i in range(160):
        w = []
        for _ in range(int(rng.integers(1, 5))):
            w += [f"u{rng.integers(30)}" for _ in range(int(rng.integers(0, 25)))]
            w += passages[int(rng.integers(6))] if rng.random() < 0.6 else []
            w += ["same"] * int(rng.integers(0, 60)) if rng.random() < 0.2 else []
            w += ["ab", "cd", "ef"] * int(rng.integers(0, 20)) if rng.random() < 0.2 else []
        rows.append((None if i % 53 == 9 else int(rng.integers(90)), "  ".join(w) + "\n" * (i % 3)))
    return rows


@pytest.mark.parametrize(("hot", "length"), [(recompress.HOT_CODE, 20), (1, 20), (recompress.HOT_CODE, 7), (5, 33)])
def test_recompression_of_odd_rows(spark, hot, length):
    rows = odd_rows()
    assert removed(texts(spark, rows), hot_code=hot, length=length) == removed_brute(rows, length)


def test_equal_windows_have_equal_anchors():
    """What is left of a window depends on its words alone, whatever stands around it."""
    rng = np.random.default_rng(7)
    for _ in range(60):
        alphabet = int(rng.integers(1, 12))
        inner = [f"w{rng.integers(alphabet)}" for _ in range(20)]
        found = set()
        for _ in range(6):
            before, after = ([f"w{rng.integers(alphabet)}" for _ in range(int(rng.integers(0, 15)))] for _ in range(2))
            raw = " ".join([*before, *inner, *after]).encode()
            row = recompress.B.block_row("0", np.array([0]), [0], [b""], np.array([len(raw)]), raw).to_pylist()[0]
            p = recompress.parsed(row, 20, 1)[0]
            k = int(np.flatnonzero(p.start == len(before))[0])
            found.add((int(p.anchor[k]), int(p.spot[k]) // 64 - len(before)))
        assert len(found) == 1


def test_anchors_that_collide_do_no_harm():
    """All strings of two blocks meet under one name: words alone decide what is equal, and ids and places what is earlier."""
    rng = np.random.default_rng(9)
    seen, table = [], {c: [] for c in recompress._SENT}
    base = [[f"w{rng.integers(2)}" for _ in range(30)] for _ in range(2)]
    for block in range(2):
        strings = [" ".join(base[int(rng.integers(2))][int(rng.integers(3)) :][: int(rng.integers(20, 26))]) for _ in range(40)]
        size = np.array([len(s.split()) for s in strings])
        ids, text, start = rng.integers(0, 4, 40), np.arange(40) // 2, np.arange(40) % 2 * 50
        ids = ids[text * 2]  # the strings of a text share its id
        cells = {"bucket": 0, "block": str(block), "names": np.zeros(40, np.uint64).tobytes(), "sizes": size.astype(np.int16).tobytes(), "ids": ids.astype(np.int64).tobytes(), "texts": text.astype(np.int32).tobytes(), "starts": start.astype(np.int32).tobytes(), "data": "\n".join(strings).encode()}
        for c, v in cells.items():
            table[c].append(v)
        seen += [(int(i), (block, int(t)), int(a), s.split()) for i, t, a, s in zip(ids, text, start, strings, strict=True)]
    windows = [(i, t, a + k, tuple(w[k : k + 20])) for i, t, a, w in seen for k in range(len(w) - 19)]
    want = [any(w == w2 and (i2 < i or t2 == t and a2 < a) for i2, t2, a2, w2 in windows) for i, t, a, w in windows]
    got = recompress.compare(recompress.pa.table(table)).to_pylist()
    flags = np.concatenate([np.unpackbits(np.frombuffer(r["mask"], np.uint8), count=r["n"]) for r in got]).astype(bool)
    assert flags.tolist() == want and 0 < sum(want) < len(want)


def whitened_brute(vectors):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    off = (n * fit - s) / n
    value, vector = np.linalg.eigh(off.T @ off / n)
    value, vector = value[::-1][:16], vector[:, ::-1][:, :16]
    return n, ((n * x - s) ** 2).sum(1), (n * x - s) / n @ vector / np.sqrt(value), value / ((n * fit - s) ** 2).sum() * n**3


def test_whitening(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 40)) @ np.diag(np.linspace(0.1, 2, 40))
    vectors = [*base, *base[:20]]
    odd = [(900, None), (901, [float("nan")] * 40), (902, [1.0, None]), (903, []), (904, [float("inf")] * 40)]
    short = rng.normal(size=(30, 3))
    rows = [(None if i == 5 else i % 310, [float(v) for v in r], "n", 1) for i, r in enumerate(vectors)] + [(i, v, "x", 2) for i, v in odd] + [(1000 + i, [float(v) for v in r], "s", 3) for i, r in enumerate(short)]
    rows += [(2000, [1.0], "alone", 1), (2001, [1.0], "alone", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, n int")
    got = whitening.whiten(df).toPandas()
    assert not set(got.vec_id.dropna()) & {900, 901, 902, 903, 904, 2000, 2001}
    for own, want_rows in ((got[got.vec_id.isna() | (got.vec_id < 900)], vectors), (got[got.vec_id >= 1000], short)):
        n, deviation, white, explained = whitened_brute(want_rows)
        k = white.shape[1]
        assert len(own) == len(want_rows) * k and set(own.n) == {n} and set(own.component) == set(range(1, k + 1))
        assert sorted(own[own.component == 1].deviation) == sorted(deviation.tolist())
        for c in range(1, k + 1):
            values = own[own.component == c].whitened.to_numpy()
            assert min(np.abs(np.sort(sign * values) - np.sort(white[:, c - 1])).max() for sign in (1, -1)) < 1e-8
            assert abs(own[own.component == c].explained.iloc[0] / explained[c - 1] - 1) < 1e-9
        assert own.identity_error.iloc[0] < 1e-9 and own.identity_error.nunique() == 1
    assert whitening.whiten(df.limit(0)).count() == 0


def test_whitening_deviations_do_not_wrap():
    with pytest.raises(OverflowError):
        whitening.deviations(np.array([[1 << 40, 0]]), 3, np.array([0, 0]))


def resampled_brute(docs, target, longest):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(lower))
    features = lambda t: [" ".join(w[k : k + n]) for w in [words(t)] for n in range(1, longest + 1) for k in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = np.zeros(10_000, int), np.zeros(10_000, int)
    for side, all_ in ((s, [x for _, x in docs]), (t, target)):
        for x in all_:
            for f in features(x):
                side[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10_000) / ((a + 1) * (t.sum() + 10_000)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)]
    out = []
    for i, x in docs:
        f = features(x)
        weight = sum(gain[bucket(y)] for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted([r for r, (_, x) in zip(out, docs, strict=True) if len(words(x)) >= 20 and r[0] is not None], key=lambda r: (-r[3], r[0], r[1]))
    for k, r in enumerate(fit[: 10 * len(fit) // 100]):
        r[4] = k + 1
    return sorted(map(str, out))


@pytest.mark.parametrize(("longest", "nodes", "stride"), [(1, 1 << 18, 1 << 16), (3, 50, 1 << 16), (3, 1 << 18, 7)])
def test_resampling(spark, monkeypatch, longest, nodes, stride):
    monkeypatch.setattr(resample, "NODES", nodes)
    monkeypatch.setattr(resample, "STRIDE", stride)
    rng = np.random.default_rng(2)
    docs = [(r["doc_id"], r["text"]) for r in frame(spark).collect() if r["doc_id"] not in (7, 8)]
    docs += [(100 + i, " ".join(f"w{int(k)}-É{int(k) % 3}" for k in rng.zipf(1.5, 35).clip(1, 60))) for i in range(150)] + [(110, "x y z " * 9), (110, "x y z " * 9)]
    target = ["w1 w2 w3 é1", None, "", "W1 w5"]
    got = resample.resample(texts(spark, docs), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"), longest=longest)
    assert sorted(str([r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]]) for r in got.collect()) == resampled_brute(docs, target, longest)
    empty = frame(spark, [])
    assert resample.resample(empty, empty).count() == 0 and resample.resample(texts(spark, docs), empty).count() == len(docs)


def test_ties_of_scores_go_by_id_over_all_ranges(spark):
    rows = [(i, 20, 20, 0, 5 if i % 3 else 7, 0) for i in range(400)]
    scored = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long, tie long").repartition(7)
    got = {r["doc_id"]: r["rank"] for r in resample.ranked(scored, 200).collect()}
    order = sorted(range(400), key=lambda i: (-rows[i][4], i))
    assert got == {i: (k + 1 if k < 200 else None) for k, i in enumerate(order)}
