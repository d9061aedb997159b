"""Quality functions as column expressions over counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def _d(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def _xlog(x: Column, y: Column) -> Column:
    """x ln(x / y), 0 for x = 0, infinite for y = 0."""
    return F.when(x == 0, 0.0).when(y == 0, INF).otherwise(x * F.log(F.try_divide(x, y)))


def information_content(k: Column, n: Column, p: Column) -> Column:
    """How much k of n edges surprise where p are expected: n times a Kullback-Leibler divergence."""
    k, n, p = _d(k), _d(n), _d(p)
    return F.when(n == 0, 0.0).otherwise(_xlog(k, p) + _xlog(n - k, n - p))


def subjective_interestingness(k: Column, n: Column, p: Column, length: Column | int) -> Column:
    length = F.lit(length) if isinstance(length, int) else length
    return information_content(k, n, p) / (0.3 * length + 0.5)


def density(k: Column, n: Column) -> Column:
    return F.when(n <= 1, 0.0).otherwise(F.try_divide(_d(k), _d(n) * (_d(n) - 1)))


def average_degree(k: Column, n: Column) -> Column:
    return F.when(n == 0, 0.0).otherwise(F.try_divide(2 * _d(k), _d(n)))


def inverse_conductance(k: Column, n: Column, out: Column, in_: Column) -> Column:
    cross = out + in_ - 2 * k
    return F.when(n == 0, 0.0).when(cross == 0, INF).otherwise(F.try_divide(_d(k), _d(cross)))


def simon_measure(k: Column, n: Column) -> Column:
    return F.when((n == 0) | (k == 0), -INF).otherwise(3 * _d(k) - _d(n) * (_d(n) - 1))


def segregation_index(k: Column, n: Column, out: Column, in_: Column, nodes: Column, edges: Column) -> Column:
    cross = _d(out + in_ - 2 * k)
    return 1 - F.try_divide(cross * _d(nodes) * (_d(nodes) - 1), _d(edges) * _d(n) * (_d(nodes) - _d(n)))


def edge_surplus(k: Column, n: Column, alpha: float = 1 / 3) -> Column:
    return _d(k) - alpha * _d(n) * (_d(n) - 1) / 2


def local_modularity(weight_in: Column, weight_out: Column, weight_into: Column, total: Column, n: Column) -> Column:
    m = _d(total)
    return F.when(n <= 1, -INF).otherwise(F.try_divide(_d(weight_in) - F.try_divide(_d(weight_out) * _d(weight_into), m), m))


def standard(a: float, n: Column, pos: Column, n_sg: Column, pos_sg: Column) -> Column:
    """(n_sg / n) ** a * (share in the subgroup - share in the data); a = 1 weighted relative accuracy, 0 lift, 0.5 binomial."""
    return F.when(n_sg == 0, 0.0).otherwise(F.pow(F.try_divide(_d(n_sg), _d(n)), F.lit(a)) * (F.try_divide(_d(pos_sg), _d(n_sg)) - F.try_divide(_d(pos), _d(n))))


def standard_bound(a: float, n: Column, pos: Column, n_sg: Column, pos_sg: Column) -> Column:
    """The best that a refinement can reach: all its rows positive."""
    return standard(a, n, pos, pos_sg, pos_sg)


def chi_squared(n: Column, pos: Column, n_sg: Column, pos_sg: Column, direction: str = "bidirect", least: int = 5, yates: bool = False) -> Column:
    a, b, c, d = _d(pos_sg), _d(pos - pos_sg), _d(n_sg - pos_sg), _d(n - n_sg - pos + pos_sg)
    gap = F.abs(a * d - b * c)
    gap = F.greatest(gap - _d(n) / 2, F.lit(0.0)) if yates else gap
    value = F.try_divide(_d(n) * gap * gap, (a + b) * (c + d) * (a + c) * (b + d))
    higher = F.try_divide(_d(pos_sg), _d(n_sg)) > F.try_divide(_d(pos), _d(n))
    lower = F.try_divide(_d(pos_sg), _d(n_sg)) < F.try_divide(_d(pos), _d(n))
    if direction != "bidirect":
        value = F.when(higher if direction == "positive" else lower, value).otherwise(-value)
    return F.when((n_sg < least) | (n - n_sg < least), -INF).otherwise(value)


def chi_squared_p(x: Column) -> Column:
    """Upper tail of chi-squared with one degree of freedom: erfc(sqrt(x / 2)), a rational approximation good to 1.2e-7."""
    z = F.sqrt(x / 2)
    t = 1 / (1 + 0.5 * z)
    #: Coefficients of the Chebyshev fit.
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(c[-1])
    for k in reversed(c[:-1]):
        poly = F.lit(k) + t * poly
    return t * F.exp(-z * z + poly)


def standard_numeric(a: float, mean: Column, n_sg: Column, mean_sg: Column, invert: bool = False) -> Column:
    q = F.when(n_sg == 0, 0.0).otherwise(F.pow(_d(n_sg), F.lit(a)) * (mean_sg - mean))
    return -q if invert else q


def combined(measures: list[Column], weights: list[float]) -> Column:
    out = F.lit(0.0)
    for m, w in zip(measures, weights, strict=True):
        out = out + m * w
    return out
