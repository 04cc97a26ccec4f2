"""Exact binomial statistics in constant memory per row.

All of them are tails of a binomial distribution.  A tail is a regularised incomplete
beta function: one probability in saddle-point form times a continued fraction, so
neither memory nor precision depends on the number of trials.  They are meant for
grouped counts, one row per arm, stratum or contrast.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _stirling_rest(n: float) -> float:
    """log(n!) minus Stirling's leading terms."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi)
    square = n * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / square) / square) / square) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x without cancellation near the mean."""
    if abs(x - mean) >= 0.1 * (x + mean):
        return x * math.log(x / mean) + mean - x
    ratio = (x - mean) / (x + mean)
    total, power, j = (x - mean) * ratio, 2 * x * ratio, 1
    while True:
        power *= ratio * ratio
        following = total + power / (2 * j + 1)
        if following == total:
            return total
        total, j = following, j + 1


def _probability(k: int, n: int, p: float) -> float:
    """P(X = k)."""
    if k == 0:
        return math.exp(n * math.log1p(-p))
    if k == n:
        return math.exp(n * math.log(p))
    rest = _stirling_rest(n) - _stirling_rest(k) - _stirling_rest(n - k)
    rest -= _deviance(k, n * p) + _deviance(n - k, n * (1 - p))
    return math.sqrt(n / (2 * math.pi * k * (n - k))) * math.exp(rest)


def _fraction(x: float, a: float, b: float) -> float:
    """Continued fraction of the incomplete beta function, from the front (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value, m = d, 0
    while True:
        m += 1
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            value *= step
        if abs(step - 1) < 1e-15:
            return value


def tail_at_least(k: int, n: int, p: float) -> float:
    """P(X >= k) of a binomial with 0 < p < 1."""
    if k <= 0:
        return 1.0
    if k > n:
        return 0.0
    a, b, front = k, n - k + 1, _probability(k, n, p) * (1 - p)
    if p < (a + 1) / (a + b + 2):
        return front * _fraction(p, a, b)
    return 1 - front * a / b * _fraction(1 - p, b, a)


def mcnemar_p(only_a: Column, only_b: Column) -> Column:
    """Two-sided exact McNemar p-value from the two discordant counts."""

    @F.pandas_udf("double")
    def two_sided(one: pd.Series, other: pd.Series) -> pd.Series:
        pairs = [(max(a, b), a + b) for a, b in zip(one.astype(int), other.astype(int))]
        return pd.Series([min(1.0, 2 * tail_at_least(k, n, 0.5)) for k, n in pairs], dtype="float64")

    return two_sided(only_a, only_b)


def clopper_pearson(confidence: float = 0.95):
    """Pandas UDF (successes, trials) -> struct(lower, upper), exact binomial interval."""
    half = (1.0 - confidence) / 2

    def lower(x: int, n: int) -> float:
        """p at which x or more successes become as likely as ``half``."""
        if x == 0:
            return 0.0
        low, high = 0.0, 1.0
        for _ in range(60):
            middle = (low + high) / 2
            if tail_at_least(x, n, middle) < half:
                low = middle
            else:
                high = middle
        return (low + high) / 2

    @F.pandas_udf("lower double, upper double")
    def interval(successes: pd.Series, trials: pd.Series) -> pd.DataFrame:
        counts = zip(successes.astype(int), trials.astype(int))
        rows = [(lower(x, n), 1 - lower(n - x, n)) if n else (0.0, 1.0) for x, n in counts]
        return pd.DataFrame(rows, columns=["lower", "upper"])

    return interval
