"""Learned operators: held-out accuracy, counterfactuals, and the pipeline stage by stage."""

import zlib

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodevein.llm import decontam, jaccard, langid, toxicity
from lodevein.llm.common import read
from tests.llm.data import PASSAGE, frame, texts

SF = "/root/testdata/sf0.01"


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_language_id(spark):
    docs = read(spark, SF, "documents")
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    rows = [(r["doc_id"], r["lang"]) for r in docs.collect()]
    assert all(got[i]["held_out"] == held_out(i) for i, _ in rows)
    assert np.mean([got[i]["lang_pred"] == lang for i, lang in rows if held_out(i)]) > 0.9
    odd = langid.identify(frame(spark)).collect()
    assert len(odd) == frame(spark).count() and {r["lang_pred"] for r in odd if r["doc_id"] in (1, 2, 3, 16)} == {"und"} and all(0 <= r["score"] <= 1 for r in odd)
    assert langid.identify(frame(spark, [])).count() == 0
    assert {r["lang_pred"] for r in langid.identify(texts(spark, [(1, "abc")])).collect()} == {"und"}


def test_toxicity(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == held_out(r["doc_id"]) and r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)
    ranked = sorted((r["score"], r["toxic"]) for r in got if r["held_out"])
    pos = [k for k, (_, y) in enumerate(ranked) if y]
    auc = (sum(pos) - len(pos) * (len(pos) - 1) / 2) / (len(pos) * (len(ranked) - len(pos)))
    assert auc > 0.75
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.toxicity(frame(spark), none).collect()} == {0.5}
    some = spark.createDataFrame([(4, 1, 1), (11, 1, 0), (11, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(frame(spark), some).count() == frame(spark).count() and toxicity.toxicity(frame(spark, []), labels).count() == 0


def test_swaps_keep_neutral_mentions_neutral():
    rng = np.random.default_rng(0)
    held, y = [], []
    for i in range(400):
        toxic = i % 4 == 0
        names = ["muslim"] if rng.random() < (0.7 if toxic else 0.05) else []
        held.append(sorted({*names, *(["awful"] if toxic and rng.random() < 0.7 else []), *(["nice"] if rng.random() < 0.5 else [])}))
        y.append(float(toxic))
    words = ["awful", "muslim", "nice"]
    plain = toxicity.train(held, np.array(y), np.ones(400), words, -1.0, penalty=0.0)
    fair = toxicity.train(held, np.array(y), np.ones(400), words, -1.0, penalty=toxicity.SWAP_PENALTY)
    assert plain.weights["muslim"] > 2 and abs(fair.weights["muslim"]) < 0.5 * plain.weights["muslim"]
    assert plain.score("a muslim neighbour") > 2 * fair.score("a muslim neighbour") and fair.score("an awful person") > 0.5


def test_swaps_change_all_features():
    gone, come = next(iter(toxicity.swaps({"muslim", "music", "nice"})))
    before = toxicity.features_of("muslim music nice")
    assert {"muslim", "^musl", "^musli"} == set(gone) and "^mus" not in gone  # music has it, too
    other = next(w for w in come if w in toxicity.IDENTITY["faith"])
    after = toxicity.features_of(f"{other} music nice")
    assert (set(gone), set(come)) == (before - after, after - before)


def test_fit_keeps_neutral_mentions_neutral(spark):
    """Names of four letters and more are features with all their beginnings, and fit() penalises all of them."""
    rng = np.random.default_rng(0)
    rows, marks = [], []
    for i in range(500):
        toxic = i % 4 == 0
        named = rng.random() < (0.7 if toxic else 0.05)
        rows.append((i, " ".join([*(["muslim"] if named else []), *(["awful"] if toxic and rng.random() < 0.7 else []), *(["nice"] if rng.random() < 0.5 else []), "person"])))
        marks.append((i, 1, int(toxic)))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    plain, fair = (toxicity.fit(texts(spark, rows), labels, penalty=p) for p in (0.0, toxicity.SWAP_PENALTY))
    shift = lambda m, name: np.subtract(*(np.log(p / (1 - p)) for p in (m.score(f"a {name} person"), m.score("a person"))))
    assert {"muslim", "^mus", "^musl", "^musli"} <= fair.weights.keys()
    assert shift(plain, "muslim") > 2 and abs(shift(fair, "muslim")) < 0.1 * shift(plain, "muslim")
    assert fair.score("an awful person") > 0.5


def test_common_subsequence():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = rng.integers(0, 5, int(rng.integers(1, 20))), rng.integers(0, 5, int(rng.integers(1, 20)))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontam.common_subsequence(a, b) == t[-1, -1]


def test_decontamination(spark):
    docs = read(spark, SF, "documents")
    items = [(r["item_id"], r["text"]) for r in read(spark, SF, "benchmark").collect()]
    bench = spark.createDataFrame([*items, (900, PASSAGE), (901, None), (902, ""), (903, "too short")], "item_id long, text string")
    plain = lambda t: " ".join(decontam.word_ids((t or "").encode()).astype(str))
    rows = [(r["doc_id"], f" {plain(r['text'])} ") for r in docs.collect()]
    want = {(i, k) for i, t in rows for k, x in items if f" {plain(x)} " in t}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminations(docs, bench).collect()}
    assert want and len(want & got) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(got)
    odd = decontam.contaminations(frame(spark), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in odd} == {(13, 900), (14, 900)}
    assert decontam.contaminations(frame(spark, []), bench).count() == 0 and decontam.contaminations(frame(spark), bench.limit(0)).count() == 0


def test_decontamination_finds_edited_items(spark):
    """Items with 0, 15 and 30 % of their words replaced: all that the subsequence confirms are found, whatever their cosine."""
    rng = np.random.default_rng(4)
    docs = read(spark, SF, "documents")
    pool = " ".join(r["text"] for r in docs.filter("text is not null").orderBy("doc_id").limit(200).collect()).split()
    items = [r for r in read(spark, SF, "benchmark").orderBy("item_id").collect() if len(decontam.word_ids(r["text"].encode())) >= decontam.LEAST_WORDS]
    rows, want = [], set()
    for n, share in enumerate((0.0, 0.15, 0.3)):
        for k, item in enumerate(items):
            x = [str(rng.choice(pool)) if rng.random() < share else w for w in item["text"].split()]
            i = 10_000_000 + n * len(items) + k
            rows.append((i, " ".join([*rng.choice(pool, 60), *x, *rng.choice(pool, 60)])))
            a, b = (decontam.word_ids(t.encode()) for t in (item["text"], " ".join(x)))
            if decontam.common_subsequence(a, b) >= decontam.HIGH * len(a):
                want.add((i, item["item_id"]))
    planted = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminations(planted, read(spark, SF, "benchmark")).collect()}
    assert len(want) > 1.5 * len(items) and want <= got


def test_search_where_the_space_tells_nothing():
    """In a space where all cosines are 0 a verbatim item is found."""
    ids = decontam.word_ids(PASSAGE.encode())
    index = decontam.Index([decontam.Item(7, ids, ids[-3:])], np.ones(decontam.FEATURES), np.zeros((decontam.FEATURES, decontam.RANK)), np.ones(decontam.FEATURES), decontam.LOW)
    text = np.concatenate([decontam.word_ids(b"some words before it"), ids])
    assert [x[:2] for x in index.search([1], np.array([len(text)]), text, decontam.LOW)] == [(1, 7)]


def test_short_items_and_batches(spark, monkeypatch):
    """Items under the least window are found word for word, and not over the end of a document; batches give the same rows."""
    docs = texts(spark, [(1, "He said: too SHORT, then left"), (2, "too"), (3, "short"), (4, "one"), (5, f"x {PASSAGE} y"), (6, "to short")])
    bench = spark.createDataFrame([(1, "too short"), (2, "one"), (3, PASSAGE), (4, "..."), (5, None), (None, "left")], "item_id long, text string")
    want = {(1, 1), (4, 2), (5, 3), (1, None)}
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminations(docs, bench).collect()} == want
    monkeypatch.setattr(decontam, "BATCH_ITEMS", 2)
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminations(docs, bench).collect()} == want


def test_copies_of_a_passage_are_sampled_one_by_one(spark):
    """A passage that stands 100,000 times is neither in the sample as a whole nor out of it."""
    words = decontam.tokenised(spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit(PASSAGE).alias("text")))
    n = decontam.sample_passages(words, 0.01).count()
    assert 800 < n < 1200


def test_the_space_is_fitted_on_all_passages(spark, monkeypatch):
    """A few passages among many copies of another shape the space as all passages do by dense arithmetic; none is drawn."""
    rng = np.random.default_rng(2)
    rows = [(i, PASSAGE) for i in range(300)] + [(1000 + i, " ".join(f"w{x}" for x in rng.integers(0, 90, n))) for i, n in enumerate([0, 1, 64, 65, 200, 700])]
    words = decontam.tokenised(texts(spark, rows))
    monkeypatch.setattr(decontam, "sample_passages", None)
    idf = 1 + rng.random(decontam.FEATURES)
    dense = []
    for _, text in rows:
        f = decontam.features(decontam.word_ids(text.encode()))
        for at in range(0, len(f), decontam.PASSAGE):
            own = f[at : at + decontam.PASSAGE]
            dense.append(np.bincount(own, idf[own], decontam.FEATURES) / np.sqrt((idf[own] ** 2).sum()))
    x, basis = np.array(dense), np.random.default_rng(decontam.SEED).standard_normal((decontam.FEATURES, 4))
    for _ in range(2):
        basis, r = np.linalg.qr(x.T @ (x @ basis))
    turn, squares, _ = np.linalg.svd(r)
    want, got = basis @ turn / np.sqrt(squares), decontam.latent_space(words, idf, rank=4)
    assert np.abs(np.abs(want) - np.abs(got)).max() < 1e-3 * np.abs(want).max()


def test_rows_of_words_are_no_larger_than_documents(spark):
    """Readers and Arrow put thousands of rows in a batch, so a row that packs a megabyte of documents makes one as large as its task's input."""
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit(PASSAGE + " "), 15).alias("text"))
    n = 4 * 15 * len(decontam.word_ids(PASSAGE.encode()))
    words = decontam.tokenised(docs)
    assert words.agg(F.max(F.length("ids")), F.sum(F.length("ids"))).first()[:] == (n, 3000 * n)


def test_words_of_odd_texts_and_of_groups(spark):
    """Each document has its own words, wherever its batch is cut; what a task works on at a time has few bytes, or is one document."""
    odd = frame(spark).coalesce(1)
    got = decontam.tokenised(odd)
    pairs = lambda rows: sorted((str(i), bytes(x)) for i, x in rows)
    want = pairs((r["doc_id"], decontam.word_ids((r["text"] or "").encode()).tobytes()) for r in odd.collect())
    assert pairs((r["doc_id"], r["ids"]) for r in got.collect()) == want
    table = got.toArrow().combine_chunks().to_batches()[0]
    for part in (table, table.slice(3), table.slice(5, 4), table.slice(2, 0)):
        read = [(i, x) for names, counts, ids in decontam._rows([part]) for i, x in zip(names, np.split(ids, np.cumsum(counts)[:-1]), strict=True)]
        assert pairs(read) == pairs((r["doc_id"], r["ids"]) for r in part.to_pylist())
    starts = np.array([0, 4, 4, 12, 40, 44, 48])
    assert list(decontam._groups(starts, 12)) == [(0, 3), (3, 4), (4, 6)] and list(decontam._groups(starts[:1], 12)) == []


def test_sums_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "FAN_IN", 2)
    words = decontam.tokenised(texts(spark, [(i, "a b c d " * i) for i in range(40)])).repartition(7)
    brute = {}
    for i in range(40):
        w = "a b c d ".split() * i
        for k in range(0, len(w), decontam.PASSAGE):
            for x in set(w[k : k + decontam.PASSAGE]):
                brute[x] = brute.get(x, 0) + 1
    got = decontam.frequencies(words)
    assert got[-1] == sum(-(-4 * i // decontam.PASSAGE) for i in range(40))
    for x, n in brute.items():
        assert got[decontam.features(decontam.word_ids(x.encode()))[0]] >= n


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out = [read(spark, SF, "documents")]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        f(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages_keep_the_columns(stages):
    assert len({tuple(d.columns) for d in stages[:5]}) == 1 and len({str([f.dataType for f in d.schema]) for d in stages[:5]}) == 1


def test_stage_decisions(spark, stages):
    raw, clean, lines, single, safe, mixed = stages
    model = toxicity.fit(raw, read(spark, SF, "labels"))
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in raw.collect() if model.score(r["text"]) < 0.5}
    assert lines.count() == clean.count() and lines.filter(F.length("text") != F.col("n_chars")).count() == 0
    groups = jaccard.similar_documents(single).filter("n_shingles > 0")
    assert groups.filter("doc_id != component_id").count() == 0 and single.count() < lines.count()
    assert decontam.contaminations(safe, read(spark, SF, "benchmark")).count() == 0 and safe.count() <= single.count()
    assert 0 < mixed.count() <= safe.count() and mixed.filter("taken > 3 * size or taken = 0").count() == 0


def test_stage_drops_near_copies_by_five_words(spark):
    """A word replaced among 50: 41 of 51 shingles of five words (0.804), 43 of 51 of four (0.843); among 48: 39 of 49 of five (0.796)."""
    base = [f"t{k}" for k in range(50)]
    near = [*base[:25], "x", *base[26:]]
    far = [f"s{k}" for k in range(48)]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, " ".join([*far[:24], "x", *far[25:]]))]
    kept = corpus_pipeline.drop_near_copies(spark, texts(spark, rows), SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


def near_copies_brute(rows):
    """What the Jaccard stage keeps of (id, text) rows, as the count of each: one row of each component, by plain comparison of all pairs."""
    text_of = lambda t: t or ""
    sets = {}
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", text_of(t).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[text_of(t)] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    named = sorted({(i, text_of(t)) for i, t in rows if i is not None and sets[text_of(t)]}, key=lambda x: (x[0], hashlib.sha256(x[1].encode()).digest()))
    link = {t: t for _, t in named}

    def root(t):
        while link[t] != t:
            t = link[t]
        return t

    for k, a in enumerate(link):
        for b in list(link)[:k]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                link[root(a)] = root(b)
    first = {}
    for i, t in named:
        first.setdefault(root(t), (i, t))
    out = [(i, t) for i, t in rows if i is None or not sets[text_of(t)]] + list(first.values())
    return sorted((str(i), text_of(t)) for i, t in out)


def test_stage_of_near_copies_against_brute_force(spark, stages):
    """Also where an id bears several texts, of which one is a copy: the other stays."""
    base = " ".join(f"t{k}" for k in range(60))
    rows = [(r["doc_id"], r["text"]) for r in frame(spark).collect() if r["doc_id"] not in (7, 8)]
    rows += [(51, base), (55, base), (55, "a text of its own that links to nothing at all"), (59, base + " tail"), (55, base), (51, base + " end"), (60, "x y z"), (60, "x y z")]
    docs = texts(spark, rows)
    got = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert got.columns == docs.columns and sorted((str(r["doc_id"]), r["text"] or "") for r in got.collect()) == near_copies_brute(rows)
    before = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in stages[3].collect()) == near_copies_brute(before)


def test_stages_bear_odd_rows(spark):
    docs = frame(spark).select("doc_id", "text", "lang", "source", "n_chars", "key", "h")
    for _, f in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(f(spark, docs, SF).collect(), f(spark, docs, SF).schema)
    assert docs.count() > 0
