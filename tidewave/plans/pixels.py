"""Queries on frames and label masks as pixel tables, with their SQL. Frames come from the vectors of ``embeddings``, in whole numbers; masks are a fixed pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewave.operators import images
from tidewave.plans.catalog import query
from tidewave.sources.tables import table

#: Height and width of a frame, the side of the block a cell lies in, and the intensity above which a pixel is hot.
SIDE, BLOCK, HOT = 48, 8, 1000
_PX = """px AS (SELECT vec_id // 48 AS frame, vec_id % 48 AS y, x, CASE WHEN e > 0.3 THEN 4000 ELSE greatest(CAST(floor((e + 0.5) * 250) AS BIGINT), 0) END AS v
  FROM (SELECT vec_id, i AS x, CAST(embedding[i + 1] AS DOUBLE) AS e FROM embeddings, (SELECT unnest(range(0, 48)) AS i)) WHERE vec_id // 48 < (SELECT count(*) // 48 FROM embeddings))"""
_MASK = """place AS (SELECT y, x, (y // 8) * 6 + x // 8 + 1 AS cell, y % 8 AS r, x % 8 AS c FROM (SELECT unnest(range(0, 48)) AS y) b CROSS JOIN (SELECT unnest(range(0, 48)) AS x) d),
mask AS (SELECT y, x, CASE WHEN cell % 5 <> 0 AND r BETWEEN (CASE WHEN cell % 7 = 0 THEN 0 ELSE 1 END) AND 4 + cell % 3 AND c BETWEEN 1 AND 4 + cell % 4 THEN cell ELSE 0 END AS label FROM place)"""


def frames(spark: SparkSession, d: str, only: int | None = None) -> DataFrame:
    """(seq, frame, y, x, intensity) of a recording whose rows of pixels are the vectors of ``embeddings``, 48 to a frame; large components are hot pixels."""
    e = table(spark, d, "embeddings")
    if only is not None:
        e = e.filter(F.col("vec_id").between(SIDE * only, SIDE * only + SIDE - 1))
    whole = table(spark, d, "embeddings").agg(F.floor(F.count("*") / SIDE).alias("whole"))
    p = e.select("vec_id", F.posexplode(F.slice("embedding", 1, SIDE)).alias("x", "e")).crossJoin(F.broadcast(whole)).withColumn("frame", F.floor(F.col("vec_id") / SIDE)).filter("frame < whole")
    v = F.col("e").cast("double")
    return p.select(F.lit("s").alias("seq"), "frame", (F.col("vec_id") % SIDE).alias("y"), F.col("x").cast("long").alias("x"), F.when(v > 0.3, 4000).otherwise(F.greatest(F.floor((v + 0.5) * 250), F.lit(0))).alias("intensity"))


def mask(spark: SparkSession, shift: int = 0) -> DataFrame:
    """(seq, y, x, label) of a made mask of blocks, 0 for the background; ``shift`` moves it to the right."""
    p = spark.range(SIDE * SIDE).select(F.lit("s").alias("seq"), F.floor(F.col("id") / SIDE).alias("y"), (F.col("id") % SIDE - shift).alias("_x"))
    cell = F.floor(F.col("y") / BLOCK) * 6 + F.floor(F.col("_x") / BLOCK) + 1
    r, c = F.col("y") % BLOCK, F.col("_x") % BLOCK
    inside = (cell % 5 != 0) & (r >= F.when(cell % 7 == 0, 0).otherwise(1)) & (r <= 4 + cell % 3) & c.between(F.lit(1), 4 + cell % 4) & (F.col("_x") >= 0)
    return p.select("seq", "y", (F.col("_x") + shift).alias("x"), F.when(inside, cell).otherwise(0).alias("label"))


@query(f"WITH {_PX} SELECT frame, y - 9 AS y, x - 9 AS x, v FROM px WHERE y BETWEEN 9 AND 37 AND x BETWEEN 9 AND 37")
def crop(spark, d):
    return images.crop(frames(spark, d), SIDE, SIDE, 0.61).select("frame", "y", "x", F.col("intensity").alias("v"))


@query(f"WITH {_PX}, b AS (SELECT frame, quantile_cont(v, 0.9) FILTER (y % 4 = 0 AND x % 4 = 0) AS base FROM px GROUP BY frame) SELECT frame, round(any_value(base) + 3.0 * median(abs(v - base)), 6) AS threshold FROM px JOIN b USING (frame) GROUP BY frame")
def auto_threshold(spark, d):
    return images.auto_threshold(frames(spark, d), 0.9, 3.0).select("frame", F.round("threshold", 6).alias("threshold"))


@query(f"WITH {_PX}, h AS (SELECT a.frame, a.y, a.x, avg(b.v) AS m FROM px a JOIN px b ON a.frame = b.frame AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 WHERE a.v > 1000 GROUP BY ALL) SELECT px.frame, px.y, px.x, round(coalesce(m, v), 6) AS v FROM px LEFT JOIN h ON h.frame = px.frame AND h.y = px.y AND h.x = px.x")
def hot_pixel(spark, d):
    return images.repair_hot_pixels(frames(spark, d), HOT).select("frame", "y", "x", F.round("intensity", 6).alias("v"))


@query(f"WITH {_PX}, h AS (SELECT a.frame, a.y, a.x, any_value(a.v) AS v, median(b.v) AS m FROM px a JOIN px b ON a.frame = b.frame AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.frame, a.y, a.x) SELECT frame, y, x, CASE WHEN abs(v - m) > 300 THEN m ELSE v END AS v FROM h")
def median_pixel(spark, d):
    return images.repair_by_median(frames(spark, d), 300).select("frame", "y", "x", F.col("intensity").alias("v"))


@query(f"WITH {_PX} SELECT frame, y, x, least(greatest(v, 0), 200) AS v FROM px")
def clip(spark, d):
    return images.clip(frames(spark, d), 200).select("frame", "y", "x", F.col("intensity").cast("long").alias("v"))


@query(f"WITH {_PX} SELECT frame, y - 9 AS y, x - 9 AS x, least(v, 1000) AS v FROM px WHERE y BETWEEN 9 AND 37 AND x BETWEEN 9 AND 37")
def processed_frames(spark, d):
    """Crop, then cap hot pixels: the steps of one image, each by its switch."""
    return images.process(frames(spark, d), SIDE, SIDE, roi=0.61, cap=HOT).select("frame", "y", "x", F.col("intensity").cast("long").alias("v"))


_CELLS = f"""{_MASK}, cells AS (SELECT label, count(*) AS size, CAST(floor(avg(y)) AS BIGINT) AS cy, CAST(floor(avg(x)) AS BIGINT) AS cx, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1,
string_agg(CAST(y * 48 + x AS VARCHAR), ',' ORDER BY y, x) AS pixels FROM mask WHERE label > 0 GROUP BY label)"""


@query(f"WITH {_CELLS} SELECT label, size, cy, cx, size BETWEEN 12 AND 30 AND y0 > 0 AND x0 > 0 AND y1 < 47 AND x1 < 47 AS is_valid, pixels FROM cells")
def mask_cells(spark, d):
    m = mask(spark)
    held = m.filter("label > 0").groupBy("label").agg(F.array_join(F.array_sort(F.collect_list(F.col("y") * SIDE + F.col("x"))), ",").alias("pixels"))
    return images.units(m, SIDE, SIDE, 12, 30).join(held, "label").select("label", "size", F.col("cy").cast("long").alias("cy"), F.col("cx").cast("long").alias("cx"), "is_valid", "pixels")


@query(f"WITH {_CELLS}, kept AS (SELECT * FROM cells WHERE y0 >= 11 AND x0 >= 11 AND y1 < 36 AND x1 < 36) SELECT a.label, a.cy - 9 AS cy, a.cx - 9 AS cx, string_agg(CAST(b.label AS VARCHAR), ',' ORDER BY b.label) AS neighbours FROM kept a LEFT JOIN kept b ON a.label <> b.label AND abs(a.cy - b.cy) + abs(a.cx - b.cx) <= 12 GROUP BY ALL")
def roi_filter(spark, d):
    kept = images.inside_roi(mask(spark), 9, 9, 29, 29, margin=2)
    a, b = kept.select("label", "cy", "cx"), kept.select(F.col("label").alias("other"), F.col("cy").alias("oy"), F.col("cx").alias("ox"))
    near = a.join(F.broadcast(b), (F.col("label") != F.col("other")) & (F.abs(F.col("cy") - F.col("oy")) + F.abs(F.col("cx") - F.col("ox")) <= 12), "left")
    names = F.array_join(F.array_sort(F.collect_list("other")), ",")
    return near.groupBy("label", "cy", "cx").agg(F.when(names != "", names).alias("neighbours"))


@query(f"WITH {_PX}, {_MASK} SELECT label, frame, round(avg(v), 6) AS mean_value FROM px JOIN mask USING (y, x) WHERE label > 0 GROUP BY ALL")
def mean_intensity(spark, d):
    return images.unit_traces(frames(spark, d), mask(spark)).select("label", "frame", F.round("mean", 6).alias("mean_value"))


@query(f"WITH {_MASK} SELECT DISTINCT a.y, a.x FROM mask a JOIN mask b ON abs(a.y - b.y) + abs(a.x - b.x) = 1 AND a.label <> b.label WHERE a.label > 0 OR b.label > 0")
def outline(spark, d):
    return images.outline(mask(spark)).select("y", "x")


_MOVED = _MASK + """, moved AS (SELECT y, x + 2 AS x, label FROM mask WHERE x + 2 < 48 UNION ALL SELECT y, x, 0 FROM mask WHERE x < 2), masks_joined AS (SELECT a.label > 0 AS a, b.label > 0 AS b, a.label AS la, b.label AS lb FROM mask a JOIN moved b USING (y, x)),
n AS (SELECT count(DISTINCT la) FILTER (a) AS n0, count(DISTINCT lb) FILTER (b) AS n1, count(*) AS total, count(*) FILTER (a) AS p0, count(*) FILTER (b) AS p1, count(*) FILTER (a AND b) AS common, count(*) FILTER (a AND NOT b) AS o0, count(*) FILTER (b AND NOT a) AS o1 FROM masks_joined)"""


@query(f"""WITH {_MOVED} SELECT unnest(['n_cells_t0', 'n_cells_t1', 'cell_count_diff_abs', 'cell_count_diff_rel', 'total_pixels', 'pixels_t0', 'pixels_t1', 'pixels_both', 'pixels_both_rel', 'pixels_only_t0', 'pixels_only_t1', 'pixels_only_t0_rel', 'pixels_only_t1_rel']) AS metric,
unnest([n0, n1, abs(n0 - n1), round(abs(n0 - n1) / ((n0 + n1) / 2.0), 5), total, p0, p1, common, round(2.0 * common / (p0 + p1), 5), o0, o1, round(o0 / p0, 5), round(o1 / p1, 5)]::DOUBLE[]) AS value FROM n""")
def mask_overlap(spark, d):
    return images.motion_metrics(mask(spark), mask(spark, 2)).select("metric", "value")


@query(f"WITH {_PX}, r AS (SELECT frame, min(v) AS lo, max(v) AS hi FROM px GROUP BY frame) SELECT frame, y, x, CAST(round(255.0 * (v - lo) / (hi - lo), 0) AS BIGINT) AS grey FROM px JOIN r USING (frame)")
def grey_levels(spark, d):
    return images.grey(frames(spark, d)).select("frame", "y", "x", "grey")


@query(f"WITH {_PX}, {_MASK}, r AS (SELECT min(v) AS lo, max(v) AS hi FROM px WHERE frame = 0), e AS (SELECT DISTINCT a.y, a.x FROM mask a JOIN mask b ON abs(a.y - b.y) + abs(a.x - b.x) = 1 AND a.label <> b.label WHERE a.label > 0 OR b.label > 0), g AS (SELECT px.y, px.x, CAST(round(255.0 * (v - lo) / (hi - lo), 0) AS BIGINT) AS grey, e.y IS NOT NULL AS line FROM px CROSS JOIN r LEFT JOIN e ON e.y = px.y AND e.x = px.x WHERE frame = 0) SELECT y, x, CASE WHEN line THEN 255 ELSE grey END AS red, CASE WHEN line THEN 0 ELSE grey END AS green, CASE WHEN line THEN 0 ELSE grey END AS blue FROM g")
def outline_overlay(spark, d):
    return images.overlay(frames(spark, d, 0), images.outline(mask(spark))).select("y", "x", "red", "green", "blue")


@query(f"WITH {_MASK} SELECT y, x, CASE WHEN label > 0 AND label % 3 = 0 THEN label * 2 ELSE 0 END AS value FROM mask")
def metric_overlay(spark, d):
    m = mask(spark)
    metric = m.filter("label > 0 AND label % 3 = 0").select("label").distinct().withColumn("value", F.col("label") * 2)
    return images.paint(m, metric, "value").select("y", "x", "value")


@query(f"WITH {_PX}, {_MASK}, t AS (SELECT label, frame, avg(v) AS v FROM px JOIN mask USING (y, x) WHERE label > 0 GROUP BY ALL), b AS (SELECT label, frame, CAST(v > avg(v) OVER (PARTITION BY label) AS BIGINT) AS state FROM t) SELECT f.frame, y, x, coalesce(state, 0) AS state FROM mask CROSS JOIN (SELECT DISTINCT frame FROM px) f LEFT JOIN b ON b.label = mask.label AND b.frame = f.frame")
def binary_view(spark, d):
    m = mask(spark)
    t = images.unit_traces(frames(spark, d), m)
    high = t.withColumn("state", (F.col("mean") > F.avg("mean").over(Window.partitionBy("label"))).cast("long")).select("label", "frame", "state")
    return images.paint(m.crossJoin(t.select("frame").distinct()), high, "state", ["label", "frame"]).select("frame", "y", "x", "state")


@query(f"WITH RECURSIVE {_PX}, hit AS (SELECT y, x, y * 48 + x AS id FROM px WHERE frame = 0 AND v BETWEEN 180 AND 250), step AS (SELECT a.id AS a, b.id AS b FROM hit a JOIN hit b ON abs(a.y - b.y) + abs(a.x - b.x) = 1), reach AS (SELECT a AS node, b AS other FROM step UNION SELECT r.node, s.b FROM reach r JOIN step s ON s.a = r.other) SELECT node AS pixel, least(node, min(other)) AS segment FROM reach GROUP BY node")
def threshold_segments(spark, d):
    """The mask where no learned segmentation is given: pixels of a range of intensities, joined to their neighbours."""
    return images.segments(frames(spark, d, 0).filter("intensity BETWEEN 180 AND 250"), SIDE)
