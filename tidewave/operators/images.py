"""Frames and label masks as long pixel tables: crops, hot pixels, unit traces, geometry and overlap of masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.functions import stats
from tidewave.operators import graph


def crop(pixels: DataFrame, height: int, width: int, scale: float, centred: bool = True) -> DataFrame:
    """Pixels of the region of interest, moved to its origin; all of them if ``scale`` is 1 or more."""
    if scale >= 1:
        return pixels
    h, w = int(height * scale), int(width * scale)
    y0, x0 = ((height - h) // 2, (width - w) // 2) if centred else (0, 0)
    inside = pixels.filter(F.col("y").between(y0, y0 + h - 1) & F.col("x").between(x0, x0 + w - 1))
    return inside.withColumns({"y": F.col("y") - y0, "x": F.col("x") - x0})


def repair_hot_pixels(pixels: DataFrame, threshold: float, reach: int = 1) -> DataFrame:
    """(seq, frame, y, x, intensity): pixels above ``threshold`` become the mean of their window in the original frame, itself included.

    Only the windows of hot pixels are looked up, by equality on the pixel's place.
    """
    key = ["seq", "frame", "y", "x"]
    steps = F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)])
    hot = pixels.filter(F.col("intensity") > threshold).select("seq", "frame", F.col("y").alias("hy"), F.col("x").alias("hx"), F.explode(steps).alias("s"))
    window = hot.select("seq", "frame", "hy", "hx", (F.col("hy") + F.col("s.dy")).alias("y"), (F.col("hx") + F.col("s.dx")).alias("x"))
    mean = window.join(pixels, key).groupBy("seq", "frame", F.col("hy").alias("y"), F.col("hx").alias("x")).agg(F.avg("intensity").alias("_mean"))
    return pixels.join(mean, key, "left").select(*key, F.coalesce("_mean", F.col("intensity").cast("double")).alias("intensity"))


def clip(pixels: DataFrame, threshold: float) -> DataFrame:
    return pixels.withColumn("intensity", F.greatest(F.lit(0), F.least(F.col("intensity"), F.lit(threshold))))


def units(mask: DataFrame, height: int, width: int, least: int, most: int) -> DataFrame:
    """(seq, label, size, cy, cx, is_valid) of labels above 0: whole-number centroids; valid if of fitting size and off the border."""
    border = F.max((F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == height - 1) | (F.col("x") == width - 1))
    out = mask.filter("label > 0").groupBy("seq", "label").agg(F.count("*").alias("size"), F.avg("y").cast("int").alias("cy"), F.avg("x").cast("int").alias("cx"), border.alias("_edge"))
    return out.withColumn("is_valid", F.col("size").between(least, most) & ~F.col("_edge")).drop("_edge")


def unit_traces(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """(seq, label, frame, mean): mean intensity of each label in each frame; sums are partial before the shuffle."""
    labelled = pixels.join(mask.filter("label > 0"), ["seq", "y", "x"])
    return labelled.groupBy("seq", "label", "frame").agg(F.avg("intensity").alias("mean"))


def mask_overlap(first: DataFrame, second: DataFrame) -> DataFrame:
    """(seq, n_first, n_second, shared, dice) of the labelled pixels of two masks."""
    a = first.filter("label > 0").select("seq", "y", "x", F.lit(1).alias("a"))
    b = second.filter("label > 0").select("seq", "y", "x", F.lit(1).alias("b"))
    both = a.join(b, ["seq", "y", "x"], "full").groupBy("seq")
    out = both.agg(F.count("a").alias("n_first"), F.count("b").alias("n_second"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"))
    return out.withColumn("dice", 2 * F.col("shared") / (F.col("n_first") + F.col("n_second")))


def process(pixels: DataFrame, height: int, width: int, *, roi: float = 1.0, centred: bool = True, cap: float | None = None, repair: float | None = None) -> DataFrame:
    """Crop, then repair hot pixels by their window's mean, or cap them; each step only if its figure is given."""
    out = crop(pixels, height, width, roi, centred)
    if repair is not None:
        out = repair_hot_pixels(out, repair)
    return out if cap is None else clip(out, cap)


def auto_threshold(pixels: DataFrame, part: float, scale: float, step: int = 4) -> DataFrame:
    """(seq, frame, threshold): a quantile of every ``step``-th pixel of every ``step``-th row, plus ``scale`` times the median distance of all pixels from it."""
    some = pixels.filter((F.col("y") % step == 0) & (F.col("x") % step == 0))
    base = stats.quantiles(some, ["seq", "frame"], "intensity", {"base": part})
    off = pixels.join(base, ["seq", "frame"]).withColumn("off", F.abs(F.col("intensity") - F.col("base")))
    spread = stats.quantiles(off, ["seq", "frame"], "off", {"mad": 0.5})
    return base.join(spread, ["seq", "frame"]).select("seq", "frame", (F.col("base") + scale * F.col("mad")).alias("threshold"))


def _window(pixels: DataFrame, reach: int) -> DataFrame:
    """Each pixel with the intensities around it, by equality on the neighbour's place: (2 * reach + 1) ** 2 rows a pixel."""
    steps = F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)])
    sent = pixels.select("seq", "frame", F.col("intensity").alias("near"), F.explode(steps).alias("s"), "y", "x")
    return sent.select("seq", "frame", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "near")


def repair_by_median(pixels: DataFrame, threshold: float, reach: int = 1) -> DataFrame:
    """Pixels further than ``threshold`` from the median of their window take that median. One aggregation by place, no join of pairs."""
    key = ["seq", "frame", "y", "x"]
    middle = _window(pixels, reach).groupBy(*key).agg(F.median("near").alias("_m"))
    far = F.abs(F.col("intensity") - F.col("_m")) > threshold
    return pixels.join(middle, key).select(*key, F.when(far, F.col("_m")).otherwise(F.col("intensity").cast("double")).alias("intensity"))


def inside_roi(mask: DataFrame, y0: int, x0: int, height: int, width: int, margin: int = 0) -> DataFrame:
    """(seq, label, cy, cx) of the labels whose pixels all lie inside the region less its margin; whole-number centroids from its origin."""
    box = mask.filter("label > 0").groupBy("seq", "label").agg(*[f(c).alias(f"_{n}{c}") for c in "yx" for n, f in (("lo", F.min), ("hi", F.max), ("m", F.avg))])
    fits = [F.col(f"_lo{c}") >= o + margin for c, o in (("y", y0), ("x", x0))] + [F.col(f"_hi{c}") < o + n - margin for c, o, n in (("y", y0, height), ("x", x0, width))]
    kept = box.filter(fits[0] & fits[1] & fits[2] & fits[3])
    return kept.select("seq", "label", (F.floor("_my") - y0).alias("cy"), (F.floor("_mx") - x0).alias("cx"))


def outline(mask: DataFrame) -> DataFrame:
    """(seq, y, x) of the pixels on either side of a label's border."""
    steps = F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0))])
    sent = mask.select("seq", "label", "y", "x", F.explode(steps).alias("s")).select("seq", F.col("label").alias("other"), (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    edge = sent.groupBy("seq", "y", "x").agg(F.min("other").alias("lo"), F.max("other").alias("hi"))
    # Labels are not negative, so two different ones always include one above 0.
    return mask.join(edge, ["seq", "y", "x"]).filter((F.col("lo") != F.col("label")) | (F.col("hi") != F.col("label"))).select("seq", "y", "x")


def motion_metrics(first: DataFrame, second: DataFrame) -> DataFrame:
    """(seq, metric, value): the thirteen figures of how cells and their pixels differ between two masks of one shape."""
    a, b = first.select("seq", "y", "x", F.col("label").alias("a")), second.select("seq", "y", "x", F.col("label").alias("b"))
    la, lb = F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))
    n = a.join(b, ["seq", "y", "x"], "full").groupBy("seq").agg(
        F.countDistinct(F.when(la > 0, F.col("a"))).alias("n0"), F.countDistinct(F.when(lb > 0, F.col("b"))).alias("n1"), F.count("*").alias("total"), F.count_if(la > 0).alias("p0"), F.count_if(lb > 0).alias("p1"),
        F.count_if((la > 0) & (lb > 0)).alias("both"), F.count_if((la > 0) & (lb <= 0)).alias("o0"), F.count_if((lb > 0) & (la <= 0)).alias("o1"),
    )
    c = F.col
    off, rel = F.abs(c("n0") - c("n1")), lambda x, y: F.round(x / F.nullif(y, F.lit(0)), 5)
    values = {
        "n_cells_t0": c("n0"), "n_cells_t1": c("n1"), "cell_count_diff_abs": off, "cell_count_diff_rel": F.coalesce(F.round(off / F.nullif((c("n0") + c("n1")) / 2, F.lit(0.0)), 5), F.lit(0.0)), "total_pixels": c("total"),
        "pixels_t0": c("p0"), "pixels_t1": c("p1"), "pixels_both": c("both"), "pixels_both_rel": rel(2 * c("both"), c("p0") + c("p1")), "pixels_only_t0": c("o0"), "pixels_only_t1": c("o1"),
        "pixels_only_t0_rel": rel(c("o0"), c("p0")), "pixels_only_t1_rel": rel(c("o1"), c("p1")),
    }
    return n.select("seq", *[v.cast("double").alias(k) for k, v in values.items()]).unpivot(["seq"], list(values), "metric", "value")


def grey(pixels: DataFrame) -> DataFrame:
    """``pixels`` with ``grey``, 0 to 255 between the least and the largest intensity of the frame; null in a frame of one intensity."""
    ends = pixels.groupBy("seq", "frame").agg(F.min("intensity").alias("_lo"), F.max("intensity").alias("_hi"))
    share = (F.col("intensity") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0))
    return pixels.join(ends, ["seq", "frame"]).withColumn("grey", F.round(255 * share).cast("long")).drop("_lo", "_hi")


def overlay(pixels: DataFrame, lines: DataFrame) -> DataFrame:
    """(seq, frame, y, x, red, green, blue): the grey frame with ``lines`` (seq, y, x) in red."""
    marked = grey(pixels).join(lines.withColumn("_line", F.lit(True)), ["seq", "y", "x"], "left")
    other = F.when(F.col("_line"), 0).otherwise(F.col("grey"))
    return marked.select("seq", "frame", "y", "x", F.when(F.col("_line"), 255).otherwise(F.col("grey")).alias("red"), other.alias("green"), other.alias("blue"))


def paint(mask: DataFrame, metric: DataFrame, name: str, keys: list[str] | None = None) -> DataFrame:
    """``mask`` with the metric ``name`` of each pixel's label, 0 where there is none."""
    keys = keys or ["label"]
    return mask.join(metric.select(*keys, name), keys, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def segments(pixels: DataFrame, width: int) -> DataFrame:
    """(pixel, segment): pixels (y * width + x) joined to their four neighbours; a segment is named by its least pixel. Single pixels go."""
    at = pixels.select("y", "x", (F.col("y") * width + F.col("x")).alias("a"))
    steps = F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i, j in ((0, 1), (1, 0))])
    near = at.select("a", F.explode(steps).alias("s"), "y", "x").select("a", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    links = near.join(at.withColumnRenamed("a", "b"), ["y", "x"]).select("a", "b")
    return graph.connected(links).select(F.col("node").alias("pixel"), F.col("label").alias("segment"))
