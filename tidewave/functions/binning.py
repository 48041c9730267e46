"""Classes, histograms and binned tables as expressions. Bins of a range come from one row of its ends, which is sent to all tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def padded_class(column: str, top: int):
    """Two digits below ``top``, from there ``top+``."""
    return F.when(F.col(column) >= top, f"{top}+").otherwise(F.lpad(F.col(column).cast("string"), 2, "0"))


def capped_class(column: str, top: int):
    return F.when(F.col(column) >= top, f"{top}+").otherwise(F.col(column).cast("string"))


def ranges_class(column: str, ends: list[int]):
    """Classes named by their whole numbers (``0``, ``1-2``): each goes to one of ``ends``, the last has no end."""
    out = None
    for lo, hi in zip([-1, *ends], ends):
        name = str(hi) if hi == lo + 1 else f"{lo + 1}-{hi}"
        out = F.when(F.col(column) <= hi, name) if out is None else out.when(F.col(column) <= hi, name)
    return out.otherwise(f"{ends[-1] + 1}+")


def _with_range(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` with _lo and _hi. A range of one value is widened by a half on both sides."""
    ends = rows.agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
    wide = F.when(F.col("_a") == F.col("_b"), 0.5).otherwise(0.0)
    return rows.crossJoin(F.broadcast(ends.select((F.col("_a") - wide).alias("_lo"), (F.col("_b") + wide).alias("_hi"))))


def equal_width(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """``rows`` with ``bin`` (left-closed, the last one closed) and its ``centre``."""
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1))
    return _with_range(rows, value).withColumn("bin", at).withColumn("centre", F.col("_lo") + width * (F.col("bin") + 0.5)).drop("_lo", "_hi")


def right_closed(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """``rows`` with ``bin``; bins hold their right edge, the first one the least value, too."""
    width = (F.col("_hi") - F.col("_lo")) / bins
    return _with_range(rows, value).withColumn("bin", F.greatest(F.ceil((F.col(value) - F.col("_lo")) / width) - 1, F.lit(0))).drop("_lo", "_hi")


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n, left_edge) of all ``bins`` bins, empty ones included. An empty input gives none."""
    ends = rows.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi")).filter("lo IS NOT NULL")
    counts = equal_width(rows.select(value), value, bins).groupBy("bin").agg(F.count("*").alias("n"))
    spine = rows.sparkSession.range(bins).withColumnRenamed("id", "bin")
    out = spine.join(F.broadcast(counts), "bin", "left").crossJoin(F.broadcast(ends))
    wide = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)
    edge = F.col("lo") - wide + F.col("bin") * (F.col("hi") - F.col("lo") + 2 * wide) / bins
    return out.select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.round(edge, 4).alias("left_edge"))


def distribution(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, population deviation, ends and count of the values that are not null; zeros where there is none."""
    zero = lambda c, places=None: F.coalesce(c if places is None else F.round(c, places), F.lit(0.0))
    return rows.groupBy(*keys).agg(zero(F.avg(value), 6).alias("mean"), zero(F.stddev_pop(value), 6).alias("std"), zero(F.min(value)).alias("lo"), zero(F.max(value)).alias("hi"), F.count(value).alias("n"))


def entropy(rows: DataFrame, keys: list[str], value: str, bins: int = 10) -> DataFrame:
    """(keys, entropy): natural entropy of each group's histogram of ``bins`` equal bins; null below two values, 0 if one bin holds all."""
    ends = rows.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count("*").alias("_n"))
    wide = F.when(F.col("_lo") == F.col("_hi"), 0.5).otherwise(0.0)
    width = (F.col("_hi") - F.col("_lo") + 2 * wide) / bins
    at = F.least(F.floor((F.col(value) - F.col("_lo") + wide) / width), F.lit(bins - 1))
    counts = rows.filter(F.col(value).isNotNull()).join(ends, keys).groupBy(*keys, "_n", at.alias("_bin")).agg(F.count("*").alias("_c"))
    p = F.col("_c") / F.col("_n")
    return counts.groupBy(*keys).agg(F.when(F.max("_n") > 1, F.sum(-p * F.log(p))).alias("entropy"))


def hexagons(rows: DataFrame, u: str, v: str) -> DataFrame:
    """``rows`` with the axial coordinates (q, r) of the hexagon around (u, v): the nearest of the rounded cube coordinates."""
    x, y = F.col(u) - F.col(v) / 2, F.col(v)
    q, r = F.round(x), F.round(y)
    dq, dr = x - q, y - r
    off = F.abs(dq + dr) > 0.5
    return rows.withColumns({"q": F.when(off & (F.abs(dq) >= F.abs(dr)), q + F.signum(dq)).otherwise(q).cast("long"), "r": F.when(off & (F.abs(dq) < F.abs(dr)), r + F.signum(dr)).otherwise(r).cast("long")})


def heatmap(rows: DataFrame, x: str, y: str, value: str, clip: tuple[float, float]) -> DataFrame:
    """Every pair of an x and a y bin: count, median, log of the clipped sum, and shares of the row and the column."""
    from tidewave.functions import stats

    sums = rows.groupBy(x, y).agg(F.count("*").alias("n"), F.sum(value).alias("s"))
    medians = stats.quantiles(rows, [x, y], value, {"m": 0.5})
    grid = sums.select(x).distinct().crossJoin(F.broadcast(sums.select(y).distinct()))
    full = grid.join(sums.join(medians, [x, y]), [x, y], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "s": F.coalesce("s", F.lit(0.0))})
    ends = full.agg(F.percentile("s", F.lit(clip[0])).alias("lo"), F.percentile("s", F.lit(clip[1])).alias("hi"))
    share = lambda key: F.round(F.col("n") / F.nullif(F.sum("n").over(Window.partitionBy(key)), F.lit(0)), 6)
    clipped = F.log1p(F.least(F.greatest("s", "lo"), "hi"))
    return full.crossJoin(F.broadcast(ends)).select(x, y, "n", F.round("m", 4).alias("median_value"), F.round(clipped, 6).alias("clipped_log"), share(x).alias("row_share"), share(y).alias("column_share"))
