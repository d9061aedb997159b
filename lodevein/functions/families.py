"""Families of edge weights: what the natural parameter x of a cell says of its weight w.

The likelihood of w is exp(w x - log_partition(x)): a probability of 0 and 1 (bernoulli) or of 0, 1, 2, ... (geometric), and a density over
w >= 0 (exponential).  The last two ask for x < 0.  At x = -inf a weight is 0 for certain.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Bernoulli:
    name, top = "bernoulli", np.inf

    @staticmethod
    def start(mean: float) -> float:
        return float(np.log(mean / (1 - mean)))

    @staticmethod
    def mean(x: np.ndarray) -> np.ndarray:
        return np.where(np.isneginf(x), 0.0, 1 / (1 + np.exp(-np.clip(x, -700, 700))))

    @classmethod
    def slope(cls, x: np.ndarray) -> np.ndarray:
        p = cls.mean(x)
        return p * (1 - p)

    @staticmethod
    def log_partition(x: np.ndarray) -> np.ndarray:
        return np.logaddexp(0, x)

    @staticmethod
    def mean_of(x: Column) -> Column:
        return 1 / (1 + F.exp(-x))

    @staticmethod
    def log_partition_of(x: Column) -> Column:
        return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


class Geometric:
    name, top = "geometric", 0.0

    @staticmethod
    def start(mean: float) -> float:
        return float(np.log(mean / (1 + mean)))

    @staticmethod
    def mean(x: np.ndarray) -> np.ndarray:
        return -np.exp(x) / np.expm1(x)

    @staticmethod
    def slope(x: np.ndarray) -> np.ndarray:
        return np.exp(x) / np.expm1(x) ** 2

    @staticmethod
    def log_partition(x: np.ndarray) -> np.ndarray:
        return -np.log(-np.expm1(x))

    @staticmethod
    def mean_of(x: Column) -> Column:
        return -F.exp(x) / F.expm1(x)

    @staticmethod
    def log_partition_of(x: Column) -> Column:
        return -F.log(-F.expm1(x))


class Exponential:
    name, top = "exponential", 0.0

    @staticmethod
    def start(mean: float) -> float:
        return -1 / mean

    @staticmethod
    def mean(x: np.ndarray) -> np.ndarray:
        return -1 / x

    @staticmethod
    def slope(x: np.ndarray) -> np.ndarray:
        return 1 / x**2

    @staticmethod
    def log_partition(x: np.ndarray) -> np.ndarray:
        return -np.log(-x)

    @staticmethod
    def mean_of(x: Column) -> Column:
        return -1 / x

    @staticmethod
    def log_partition_of(x: Column) -> Column:
        return -F.log(-x)


Family = type[Bernoulli] | type[Geometric] | type[Exponential]
FAMILIES: dict[str, Family] = {f.name: f for f in (Bernoulli, Geometric, Exponential)}


def family_of(name: str) -> Family:
    if name not in FAMILIES:
        raise ValueError(f"unknown family {name!r}")
    return FAMILIES[name]


def log_likelihood(family: Family, weight: Column, x: Column) -> Column:
    """Of an observed weight; 0 of weight 0 where there can be no other, and -inf of any other there."""
    never = x == float("-inf")
    return F.when(never, F.when(weight == 0, 0.0).otherwise(float("-inf"))).otherwise(weight * x - family.log_partition_of(x))
