"""Concordant and discordant pairs without a pair table: values are cut into blocks, and only blocks are ever compared as wholes."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.operators.graph import cut, release

#: Distinct (x, y) a block holds on average, and the most blocks an axis is cut into: the table of block counts, which the driver reads, has at most its square of rows times four.
BLOCK, MOST = 50_000, 256


def signed_pairs(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> int:
    """Sum over pairs with x_i < x_j of w_i * w_j * sign(y_j - y_i), in n log² n steps: ranks of x are compared by their highest differing bit."""
    rx, ry = np.unique(x, return_inverse=True)[1], np.unique(y, return_inverse=True)[1]
    total = 0
    for bit in range(int(rx.max(initial=0)).bit_length()):
        half = rx >> (bit + 1)
        order = np.lexsort((ry, half))
        g, v, weight = half[order], ry[order], w[order].astype(np.int64)
        right = (rx[order] >> bit) & 1
        left = np.where(right, 0, weight)
        upto = np.cumsum(left)
        group = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        run = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])])
        of_group = np.repeat(np.arange(len(group)), np.diff(np.r_[group, len(g)]))
        of_run = np.repeat(np.arange(len(run)), np.diff(np.r_[run, len(g)]))
        base = (upto - left)[group][of_group]
        less = (upto - left)[run][of_run] - base
        last = upto[np.r_[run[1:], len(g)] - 1][of_run]
        more = upto[np.r_[group[1:], len(g)] - 1][of_group] - last
        total += int((np.where(right, weight, 0) * (less - more)).sum())
    return total


def _edges(c: DataFrame, column: str, blocks: int) -> list[float]:
    if blocks < 2:
        return []
    at = [i / blocks for i in range(1, blocks)]
    return sorted(set(c.agg(F.percentile_approx(column, at, 10_000).alias("e")).first()["e"] or []))


def _block(edges: list[float]):
    """Blocks by order: odd ones hold one value, an edge, so that a frequent value never shares a block; even ones what lies between two edges."""
    held = np.array(edges, float)

    @F.pandas_udf("int")
    def block(v: pd.Series) -> pd.Series:
        low = np.searchsorted(held, v.to_numpy(), "left")
        return pd.Series((2 * low + (np.searchsorted(held, v.to_numpy(), "right") > low)).astype(np.int32))

    return block


def concordance(rows: DataFrame, x: str, y: str, size: int = BLOCK) -> DataFrame:
    """One row (n, s, tied_x, tied_y): rows, concordant minus discordant pairs, and pairs tied in x and in y; nulls and NaN are left out.

    Equal rows are counted first. Both axes are cut into blocks of about equal counts; pairs in different blocks of both axes follow from the
    table of block counts, pairs in one block of x from that block, and pairs in one block of y alone from that one. So rows are shuffled three
    times and nothing grows faster than they do. Blocks of one value hold no pair that counts.
    """
    c = rows.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").groupBy("x", "y").agg(F.count("*").alias("n"))
    c = cut(c)
    blocks = min(MOST, -(-c.count() // size))
    coded = cut(c.withColumns({"bx": _block(_edges(c, "x", blocks))("x"), "by": _block(_edges(c, "y", blocks))("y")}))

    def inside(key: str, other: str):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            first = pdf["x"] if key == "bx" else pdf[other]
            return pd.DataFrame({"s": [str(signed_pairs(first.to_numpy(), pdf["y"].to_numpy(), pdf["n"].to_numpy()))]})

        return coded.filter(F.col(key) % 2 == 0).groupBy(key).applyInPandas(run, "s string")

    near = inside("bx", "by").union(inside("by", "bx")).agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).first()["s"]
    held = coded.groupBy("bx", "by").agg(F.sum("n").alias("n")).collect()
    table = np.zeros((max((r["bx"] for r in held), default=0) + 1, max((r["by"] for r in held), default=0) + 1), object)
    for r in held:
        table[r["bx"], r["by"]] = r["n"]
    far, below = 0, np.zeros(table.shape[1], object)
    for row, after in pairwise(table):
        below = below + row
        upto = np.cumsum(below)
        far += int((after * (upto - below - (upto[-1] - upto))).sum())
    tied = {a: c.groupBy(a).agg(F.sum("n").alias("k")).agg(F.sum(F.col("k").cast("double") * (F.col("k") - 1) / 2)).first()[0] or 0.0 for a in "xy"}
    n = c.agg(F.sum("n")).first()[0] or 0
    release(c, coded)
    return rows.sparkSession.createDataFrame([(n, float(int(near or 0) + far), tied["x"], tied["y"])], "n long, s double, tied_x double, tied_y double")


def kendall(rows: DataFrame, x: str, y: str, size: int = BLOCK) -> DataFrame:
    """One row (tau_b): Kendall's rank correlation with ties; null if a variable is constant."""
    c, n = concordance(rows, x, y, size), F.col("n").cast("double")
    w = n * (n - 1) / 2
    return c.select((F.col("s") / F.nullif(F.sqrt((w - F.col("tied_x")) * (w - F.col("tied_y"))), F.lit(0.0))).alias("tau_b"))
