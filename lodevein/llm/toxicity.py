"""Counterfactual-regularised toxicity classifier.

A logistic model over the presence of words and of word beginnings (an insult that is inflected keeps its stem).  Beside the usual loss, each labelled text that names a group of people is
paired with texts in which the name is swapped for others of its kind, and the squared change of the logit is
penalised, so that a neutral mention of a group doesn't move the score.  A swap changes all features that differ between the
two texts: the names and their beginnings, but for beginnings that another word of the text has, too.

The model is fitted on a bounded sample of labelled rows (``sample``, by a hash of the id); its words are those that
differ most between the classes (chi-squared), ``words`` at most.  Scoring reads every whole text.

Defined results: null and empty texts get the model's base score; rows of null label or null id teach nothing; with no
labels, or labels of one class, the score is the smoothed base rate; repeated rows teach and are scored each time; an
empty table gives an empty result; texts of any length are read whole; equal scores need no order; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevein.llm.common import learns

SAMPLE = 8_000
WORDS = 1024
LEAST_CHI2 = 10.0
SWAP_PENALTY = 12.0
RIDGE = 0.0005

#: Words that name groups of people, by kind; a swap stays within a kind.
IDENTITY = {
    "gender": ("woman", "man", "women", "men", "female", "male", "transgender", "mujer", "hombre", "femme", "homme", "frau", "mann"),
    "faith": ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "musulmán", "cristiano", "judío", "musulman", "chrétien", "juif", "muslimisch", "christlich", "jüdisch"),
    "origin": ("black", "white", "asian", "african", "european", "latino", "arab", "american", "mexican", "chinese", "immigrant"),
    "orientation": ("gay", "lesbian", "straight", "bisexual", "queer", "heterosexual", "homosexual"),
    "other": ("deaf", "blind", "disabled", "old", "young", "elderly"),
}
_WORD = re.compile(r"[^\W\d_]+")


#: Lengths of the word beginnings that are features; "^" marks them.
STEMS = (3, 4, 5, 6, 7, 8)


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features(words: set[str]) -> set[str]:
    return words.union(*({"^" + w[:k] for w in words if len(w) > k} for k in STEMS))


def features_of(text: str | None) -> set[str]:
    return features(words_of(text))


def swaps(words: set[str], identity: dict[str, tuple[str, ...]] = IDENTITY) -> Iterator[tuple[list[str], list[str]]]:
    """For each group named, and each other of its kind that the text lacks: the features that go and those that come."""
    for kind in identity.values():
        for w in sorted(words & set(kind)):
            before, rest = features({w}), features(words - {w})
            for v in kind:
                if v not in words:
                    after = features({v})
                    yield sorted(before - after - rest), sorted(after - before - rest)


def swap_weights(words: set[str], identity: dict[str, tuple[str, ...]] = IDENTITY) -> dict[tuple[tuple[str, ...], tuple[str, ...]], float]:
    """The swaps of a text; those of all names together weigh as many as names are swapped."""
    found = [(tuple(gone), tuple(come)) for gone, come in swaps(words, identity)]
    named = sum(len(words & set(kind)) for kind in identity.values() if set(kind) - words)
    out: dict = {}
    for x in found:
        out[x] = out.get(x, 0.0) + named / len(found)
    return out


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def __post_init__(self) -> None:
        self.stems = {k: {w[1:] for w in self.weights if w[0] == "^" and len(w) == k + 1} for k in STEMS}
        self.stems = {k: known for k, known in self.stems.items() if known}

    def score(self, text: str | None) -> float:
        words = words_of(text)
        held = self.weights.keys() & words
        for k, known in self.stems.items():
            held |= {"^" + w for w in known & {w[:k] for w in words if len(w) > k}}
        z = self.bias + sum(self.weights[w] for w in sorted(held))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def labelled_words(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, identity: dict[str, tuple[str, ...]] = IDENTITY) -> DataFrame:
    """y, words, swaps: the bounded training sample as sets of features, with what swaps of names change."""
    marks = labels.filter(F.col("toxic").isNotNull() & learns(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("y"))
    n = marks.count()
    share = min(1.0, sample / max(n, 1))
    chosen = marks.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    rows = docs.select("doc_id", "text").join(chosen, "doc_id")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [words_of(t) for t in b.column("text").to_pylist()]
            held = pa.array([sorted(features(w)) for w in words], pa.list_(pa.string()))
            changes = pa.array([[{"gone": gone, "come": come, "weight": x} for (gone, come), x in swap_weights(w, identity).items()] for w in words], pa.list_(pa.struct({"gone": pa.list_(pa.string()), "come": pa.list_(pa.string()), "weight": pa.float64()})))
            yield pa.RecordBatch.from_arrays([b.column("y"), held, changes], ["y", "words", "swaps"])

    return rows.select("y", "text").mapInArrow(split, "y int, words array<string>, swaps array<struct<gone: array<string>, come: array<string>, weight: double>>")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, words: int = WORDS, penalty: float = SWAP_PENALTY, identity: dict[str, tuple[str, ...]] = IDENTITY) -> Model:
    """The model; ``identity`` has the words that name groups, by kind."""
    rows = labelled_words(docs, labels, sample, identity).persist()
    try:
        totals = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
        n1, n0 = totals.get(1, 0), totals.get(0, 0)
        base = math.log((n1 + 0.5) / (n0 + 0.5)) if n1 + n0 else 0.0
        if not n1 or not n0:
            return Model({}, base)
        n = n1 + n0
        a, both = F.col("a"), F.col("n")
        # Chi-squared of the 2 x 2 table of word and label, from the counts of documents that hold the word.
        chi2 = n * F.pow(a * (n0 - (both - a)) - (both - a) * (n1 - a), 2) / (both * (n - both) * float(n1) * n0)
        seen = rows.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.sum("y").cast("double").alias("a"), F.count("*").cast("double").alias("n"))
        strong = seen.filter((both >= 3) & (both < n)).withColumn("chi2", chi2).filter(F.col("chi2") >= LEAST_CHI2)
        vocabulary = [r["word"] for r in strong.orderBy(F.desc("chi2"), "word").limit(words).collect()]
        names = [r["word"] for r in seen.filter(F.col("word").isin(sorted({w for kind in identity.values() for w in kind}))).collect()]
        vocabulary = sorted({*vocabulary, *names})
        if not vocabulary:
            return Model({}, base)
        known = F.array(*map(F.lit, vocabulary))
        held = F.array_intersect("words", known)
        # Texts with the same words and label are one row with a count: bounded by the sample in any case.
        x = rows.groupBy("y", F.array_sort(held).alias("held")).count().collect()
        changed = rows.select(F.explode("swaps").alias("s")).select(*(F.array_sort(F.array_intersect(f"s.{c}", known)).alias(c) for c in ("gone", "come")), "s.weight")
        # Rounded, as the order of a sum isn't fixed.
        summed = changed.groupBy("gone", "come").agg(F.round(F.sum("weight"), 6).alias("weight")).orderBy("gone", "come")
        changes = {(tuple(r["gone"]), tuple(r["come"])): r["weight"] for r in summed.collect()}
    finally:
        rows.unpersist()
    return train([r["held"] for r in x], np.array([r["y"] for r in x], float), np.array([r["count"] for r in x], float), vocabulary, base, penalty, changes=changes)


def train(held: list[list[str]], y: np.ndarray, count: np.ndarray, words: list[str], base: float, penalty: float = SWAP_PENALTY, rounds: int = 30, changes: dict[tuple[tuple[str, ...], tuple[str, ...]], float] | None = None) -> Model:
    """Newton steps on loss, ridge and swap penalty; the matrix has a column for each of a bounded number of words.

    ``changes`` weighs the swaps by the features that go and come; where it isn't given, ``held`` are taken for whole texts.
    """
    at = {w: i for i, w in enumerate(words)}
    k = len(words)
    x = np.zeros((len(held), k + 1), np.float32)
    x[:, k] = 1
    for i, ws in enumerate(held):
        x[i, [at[w] for w in ws]] = 1
    if changes is None:
        changes = {}
        for ws, c in zip(held, count, strict=True):
            for swap, weight in swap_weights({w for w in ws if w[0] != "^"}).items():
                changes[swap] = changes.get(swap, 0.0) + weight * c
    n = count.sum()
    fixed = np.eye(k + 1) * RIDGE
    fixed[k, k] = 1e-6
    d = np.zeros((len(changes), k + 1))  # a feature that the model doesn't hold has weight 0
    for row, (gone, come) in zip(d, changes, strict=True):
        row[[at[w] for w in gone if w in at]] = 1
        row[[at[w] for w in come if w in at]] = -1
    fixed += penalty / n * d.T @ (d * np.array(list(changes.values()))[:, None])
    w = np.zeros(k + 1)
    w[k] = base

    def loss(v: np.ndarray) -> float:
        z = x @ v.astype(np.float32)
        return float((count * (np.logaddexp(0, z) - y * z)).sum() / n + v @ fixed @ v / 2)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -40, 40)))
        g = x.T @ (count * (p - y)).astype(np.float32) / n + fixed @ w
        h = (x * (count * p * (1 - p) / n).astype(np.float32)[:, None]).T @ x + fixed
        step, size = np.linalg.solve(h + 1e-9 * np.eye(k + 1), g), 1.0
        while size > 1e-3 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if abs(before - now) < 1e-9:
            break
    return Model({word: float(w[i]) for word, i in at.items()}, float(w[k]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = pa.array([model.score(t) for t in b.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), scores], ["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rated = docs.select("doc_id", (~learns(F.col("doc_id"))).alias("held_out"), "text").mapInArrow(rate, f"doc_id {kind}, held_out boolean, score double")
    return rated.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model doesn't reject, with their columns as they were."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.score(t) < 0.5 for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(rate, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
