"""Background models: maximum-entropy priors over edges and belief updates.

A model has a logit for every pair of nodes, the sum of a row and a column parameter and of those of the patterns that hold
both ends.  Nodes of equal degrees, labels and pattern memberships are exchangeable, so the solver sees a table of classes, whose
number follows the number of distinct degrees and not of nodes; it is bounded by ``most`` and checked.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevein.functions.families import family_of

MOST_CLASSES = 4096


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def uniform_logit(density: float) -> float:
    return math.log(density / (1 - density))


def degree_classes(margins: DataFrame, labels: list[str] | None = None, most: int = MOST_CLASSES) -> tuple[DataFrame, list]:
    """The table of classes (class, out_degree, in_degree, ..., n) at the driver, behind a check of its size."""
    keys = ["out_degree", "in_degree", *(labels or [])]
    rows = margins.groupBy(*keys).agg(F.count("*").alias("n")).orderBy(*keys).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} classes of nodes")
    return margins, rows


def fit_degrees(out_degree: np.ndarray, in_degree: np.ndarray, n: np.ndarray, square: bool = True, family: str = "bernoulli", rounds: int = 5000, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Row and column parameters of the classes, so that expected margins are the given ones.

    Alternating one-dimensional Newton steps on the rows and on the columns, each of which is concave and monotone.
    A class of degree 0 has parameter -inf (no edges).  Families: bernoulli, geometric, exponential.
    """
    r, k, n = (np.asarray(x, float) for x in (out_degree, in_degree, n))
    m = max(r @ n, 1.0)
    with np.errstate(divide="ignore"):
        a, b = np.log(r) - 0.5 * math.log(m), np.log(k) - 0.5 * math.log(m)
    if family != "bernoulli":
        shift = max(0.0, np.max(a[np.isfinite(a)], initial=-1) + np.max(b[np.isfinite(b)], initial=-1) + 1)
        a, b = a - shift / 2, b - shift / 2

    def mean(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if family == "bernoulli":
            p = np.where(np.isneginf(x), 0.0, sigmoid(x))
            return p, p * (1 - p)
        if family == "geometric":
            e = np.exp(np.minimum(x, -1e-12))
            return e / (1 - e), e / (1 - e) ** 2
        x = np.minimum(x, -1e-12)
        return np.where(np.isneginf(x), 0.0, -1 / x), np.where(np.isneginf(x), 0.0, 1 / x**2)

    def step(u: np.ndarray, v: np.ndarray, want: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore"):
            p, d = mean(u[:, None] + v[None, :])
        own = np.diag(np.ones(len(u))) if square else 0
        count = n[None, :] - own
        got, slope = (p * count).sum(1), (d * count).sum(1)
        move = np.where(slope > 1e-300, (want - got) / np.maximum(slope, 1e-300), 0.0)
        return np.where(np.isfinite(u), u + np.clip(move, -1, 1), u)

    for _ in range(rounds):
        a = step(a, b, r)
        b = step(b, a, k)
        with np.errstate(invalid="ignore"):
            p, _ = mean(a[:, None] + b[None, :])
        count = n[None, :] - (np.diag(np.ones(len(n))) if square else 0)
        if np.abs((p * count).sum(1) - r).max() < tol * max(1.0, r.max()) and np.abs((p.T * count).sum(1) - k).max() < tol * max(1.0, k.max()):
            break
    return a, b


#: Pairs of a distinct out-degree and a distinct in-degree that the solver holds at once.
MOST_CELLS = 1 << 24


def fit_margins(out_degree: np.ndarray, in_degree: np.ndarray, n: np.ndarray, square: bool = True, rounds: int = 200, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Row and column parameters of joint classes of degrees, with one parameter for each distinct out-degree and each distinct in-degree.

    The table of cells has a row for each out-degree and a column for each in-degree, so many more joint classes than ``MOST_CLASSES`` do:
    cells of nodes with themselves are a sparse correction of it.  Expected margins are met in sum over the nodes of a degree, by Newton's steps on
    both vectors at once (the columns by elimination of the rows).  Degree 0 has parameter -inf.
    """
    r, ri = np.unique(np.asarray(out_degree, float), return_inverse=True)
    k, ki = np.unique(np.asarray(in_degree, float), return_inverse=True)
    n = np.asarray(n, float)
    if len(r) * len(k) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} pairs of an out-degree and an in-degree")
    rows, columns = np.bincount(ri, n), np.bincount(ki, n)
    cells = np.outer(rows, columns)
    if square:
        np.subtract.at(cells, (ri, ki), n)
    live_r, live_k = r > 0, k > 0
    cells = cells[np.ix_(live_r, live_k)]
    want_r, want_k = (r * rows)[live_r], (k * columns)[live_k]
    half = 0.5 * math.log(max(want_r.sum(), 1.0))
    a, b = np.log(r[live_r]) - half, np.log(k[live_k]) - half

    def gaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = sigmoid(a[:, None] + b[None, :])
        e = cells * p
        return e * (1 - p), want_r - e.sum(1), want_k - e.sum(0)

    least = 1e-12 * max(1.0, float(cells.max(initial=0)))
    for i in range(rounds):
        v, gr, gk = gaps(a, b)
        if max(np.abs(gr / rows[live_r]).max(initial=0), np.abs(gk / columns[live_k]).max(initial=0)) < tol * max(1.0, r[-1], k[-1]):
            break
        d = v.sum(1) + least
        if i < 10:  # near enough first, one side after the other
            a = a + np.clip(gr / d, -1, 1)
            v, _, gk = gaps(a, b)
            b = b + np.clip(gk / (v.sum(0) + least), -1, 1)
            continue
        left = np.diag(v.sum(0) + least) - (v / d[:, None]).T @ v
        left += 1e-10 * np.trace(left) / max(1, len(left)) * np.eye(len(left))  # a constant may go from rows to columns
        move = np.linalg.solve(left, gk - v.T @ (gr / d))
        b = b + np.clip(move, -1, 1)
        a = a + np.clip((gr - v @ move) / d, -1, 1)
    all_a, all_b = np.full(len(r), -np.inf), np.full(len(k), -np.inf)
    all_a[live_r], all_b[live_k] = a, b
    return all_a[ri], all_b[ki]


def fit_weights(out_strength: np.ndarray, in_strength: np.ndarray, n: np.ndarray, family: str = "geometric", square: bool = True, rounds: int = 200, tol: float = 1e-11) -> tuple[np.ndarray, np.ndarray]:
    """As ``fit_margins`` for sums of weights under any family: damped Newton steps on the convex dual, which stay where the family has a mean.

    Raises if margins can't be met, such as Bernoulli degrees of as many as there are nodes.
    """
    f = family_of(family)
    r, ri = np.unique(np.asarray(out_strength, float), return_inverse=True)
    k, ki = np.unique(np.asarray(in_strength, float), return_inverse=True)
    n = np.asarray(n, float)
    if len(r) * len(k) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} pairs of an outgoing and an incoming sum")
    if min(r.min(initial=0), k.min(initial=0)) < 0:
        raise ValueError("sums of weights are at least 0")
    rows, columns = np.bincount(ri, n), np.bincount(ki, n)
    cells = np.outer(rows, columns)
    if square:
        np.subtract.at(cells, (ri, ki), n)
    live_r, live_k = r > 0, k > 0
    cells = cells[np.ix_(live_r, live_k)]
    want_r, want_k = (r * rows)[live_r], (k * columns)[live_k]
    all_a, all_b = np.full(len(r), -np.inf), np.full(len(k), -np.inf)
    if not cells.sum():
        return all_a[ri], all_b[ki]
    if f.top > 0 and want_r.sum() >= cells.sum():
        raise ValueError(f"no {family} model has these margins")
    some = cells > 0
    x0 = f.start(want_r.sum() / cells.sum())
    a, b = np.full(len(want_r), x0 / 2), np.full(len(want_k), x0 / 2)

    def dual(a: np.ndarray, b: np.ndarray) -> float:
        x = a[:, None] + b[None, :]
        if not (x[some] < f.top).all():
            return np.inf
        return float((cells[some] * f.log_partition(x[some])).sum() - want_r @ a - want_k @ b)

    def gap(gr: np.ndarray, gk: np.ndarray) -> float:
        return max(np.abs(gr / want_r).max(), np.abs(gk / want_k).max())

    now = dual(a, b)
    for _ in range(rounds):
        x = np.where(some, a[:, None] + b[None, :], x0)
        e, v = cells * f.mean(x), cells * f.slope(x)
        gr, gk = want_r - e.sum(1), want_k - e.sum(0)
        if gap(gr, gk) < tol:
            break
        d = v.sum(1)
        if f.top > 0 and min(d.min(), v.sum(0).min()) < 1e-9:  # cells run to their bounds
            break
        left = np.diag(v.sum(0)) - (v / d[:, None]).T @ v
        left += 1e-12 * v.sum() / len(left) * np.ones_like(left)  # a constant may go from rows to columns: the columns' move sums to about 0
        db = np.linalg.lstsq(left, gk - v.T @ (gr / d), rcond=None)[0]
        da = (gr - v @ db) / d
        fall = float(gr @ da + gk @ db)
        step = 1.0
        while (then := dual(a + step * da, b + step * db)) > now - 1e-4 * step * fall + 1e-13 * abs(now) and step > 1e-12:
            step /= 2
        if step <= 1e-12:
            break
        a, b, now = a + step * da, b + step * db, then
    if not gap(gr, gk) <= 1e-6:
        raise ValueError(f"no {family} model has these margins")
    all_a[live_r], all_b[live_k] = a, b
    return all_a[ri], all_b[ki]


def residuals(rows: list, a: np.ndarray, b: np.ndarray, square: bool = True) -> list[tuple]:
    """(out_degree, in_degree, n, expected out, expected in) of each class under the fitted Bernoulli model."""
    n = np.array([r["n"] for r in rows], float)
    with np.errstate(invalid="ignore"):
        p = np.nan_to_num(sigmoid(a[:, None] + b[None, :])) * np.isfinite(a)[:, None] * np.isfinite(b)[None, :]
    count = n[None, :] - (np.eye(len(n)) if square else 0)
    out, in_ = (p * count).sum(1), (p.T * count).sum(1)
    return [(r["out_degree"], r["in_degree"], r["n"], float(o), float(i)) for r, o, i in zip(rows, out, in_, strict=True)]


def expected_edges(logit: np.ndarray, hist_a: np.ndarray, hist_b: np.ndarray, hist_both: np.ndarray) -> float:
    """Expected edges between two groups from their class histograms; pairs of a node with itself don't count."""
    p = np.where(np.isneginf(logit), 0.0, sigmoid(np.where(np.isneginf(logit), 0.0, logit)))
    return float(hist_a @ p @ hist_b - (hist_both * np.diag(p)).sum())


def pattern_lambda(logit: np.ndarray, pairs: np.ndarray, observed: float, limit: float = 60.0) -> float:
    """The shift of the logits of these pairs (counts by class pair) that makes the expected edges the observed ones."""
    total = pairs.sum()
    if observed <= 0:
        return -limit
    if observed >= total:
        return limit
    lo, hi = -limit, limit
    for _ in range(200):
        mid = (lo + hi) / 2
        if (pairs * sigmoid(logit + mid)).sum() < observed:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def fit_blocks(rows: list, labels: np.ndarray, block_edges: np.ndarray, rounds: int = 5000, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Degree and label-pair parameters together: margins of classes and edges between labels are met; self pairs excluded."""
    n = np.array([r["n"] for r in rows], float)
    r, k = np.array([x["out_degree"] for x in rows], float), np.array([x["in_degree"] for x in rows], float)
    g = np.zeros_like(block_edges, float)
    one = np.eye(len(g))[labels]
    a, b = np.log(np.maximum(r, 1e-9)) - 0.5 * np.log(r @ n), np.log(np.maximum(k, 1e-9)) - 0.5 * np.log(r @ n)
    pairs = n[:, None] * (n[None, :] - np.eye(len(n)))
    for _ in range(rounds):
        worst = 0.0
        for axis in (0, 1, 2):
            p = sigmoid(a[:, None] + b[None, :] + g[labels][:, labels])
            e, v = p * pairs, p * (1 - p) * pairs
            got, slope, want = ((e.sum(1), v.sum(1), r * n), (e.sum(0), v.sum(0), k * n), (one.T @ e @ one, one.T @ v @ one, block_edges))[axis]
            gap = want - got
            move = np.clip(gap / np.maximum(slope, 1e-12), -1, 1)
            worst = max(worst, np.abs(gap).max())
            if axis == 0:
                a = a + np.where(r > 0, move, 0)
            elif axis == 1:
                b = b + np.where(k > 0, move, 0)
            else:
                g = g + np.where(block_edges > 0, move, np.where(got > 1e-12, -1.0, 0.0))
        if worst < tol * max(1.0, float(block_edges.max())):
            break
    return a, b, g
