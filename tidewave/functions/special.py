"""Tails of distributions by their series and continued fractions, as columns of tests; no table is read."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if not 0 < x < 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    out = d
    for m in range(1, 1000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def gamma_rest(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function: the tail of the chi-square distribution of 2a degrees at 2x."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-17:
            k += 1
            term *= x / k
            total += term
        return 1 - front * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    out = d
    for i in range(1, 1000):
        top = -i * (i - a)
        b += 2
        d = 1 / (top * d + b or 1e-300)
        c = b + top / c or 1e-300
        out *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * out


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def student_two_sided(t: float, df: float) -> float:
    return beta_share(df / 2, 0.5, df / (df + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_share(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def exact_u_tail(u: int, n: int, m: int) -> float:
    """Two-sided exact p of the rank sum statistic without ties, from the number of orders that give each value; the smaller group gives the number of rounds."""
    n, m = sorted((n, m))
    ways = np.zeros(n * m + 1)
    ways[0] = 1.0
    for i in range(1, n + 1):
        # Each factor of the Gaussian binomial coefficient: times (1 - q^(m+i)), over (1 - q^i).
        new = ways.copy()
        if m + i <= n * m:
            new[m + i :] -= ways[: n * m + 1 - m - i]
        for first in range(i):
            new[first::i] = np.cumsum(new[first::i])
        ways = new
    share = ways / ways.sum()
    return min(1.0, 2 * share[max(u, n * m - u) :].sum())


def column(f):
    """``f`` of numbers as a column function; nulls stay null."""

    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else float(f(*row)) for row in zip(*columns)], dtype="float64")

    return run
