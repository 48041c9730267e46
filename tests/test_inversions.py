"""Pair counts by blocks against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.functions import inversions


def plain(x, y):
    dx, dy = np.sign(x[None] - x[:, None]), np.sign(y[None] - y[:, None])
    s = int((dx * dy).sum()) // 2
    tied = [int(((v[None] == v[:, None]).sum() - len(v)) // 2) for v in (x, y)]
    return len(x), s, *tied


@pytest.mark.parametrize("size", [40, 5000])
def test_concordance(spark, size):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 60, 900).astype(float), rng.normal(size=900).round(1)
    x[:300], y[200:500] = 7.0, 0.5  # one value for a third of either
    frame = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (1.0, None), (float("nan"), 2.0)], "x double, y double")
    assert tuple(inversions.concordance(frame, "x", "y", size).first()) == plain(x, y)
    n, s, tx, ty = plain(x, y)
    w = n * (n - 1) / 2
    assert np.isclose(inversions.kendall(frame, "x", "y", size).first()[0], s / ((w - tx) * (w - ty)) ** 0.5)


def test_signed_pairs():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 50):
        x, y, w = rng.integers(0, 9, n), rng.integers(0, 9, n), rng.integers(1, 4, n)
        want = sum(int(w[i] * w[j]) * int(np.sign(y[j] - y[i])) for i in range(n) for j in range(n) if x[i] < x[j])
        assert inversions.signed_pairs(x, y, w) == want


def test_constant_and_empty(spark):
    assert inversions.kendall(spark.range(5).select(F.lit(1).alias("x"), F.col("id").alias("y")), "x", "y").first()[0] is None
    assert inversions.kendall(spark.range(0).select("id", F.col("id").alias("y")), "id", "y").first()[0] is None
