"""Queries that assemble linked peaks into events and describe them, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewave.operators.graph import trees
from tidewave.plans.catalog import _EDGES, _LINKS, _PEAKS, _links, query
from tidewave.sources.tables import peaks

_TREES = """RECURSIVE up AS (SELECT event_id AS node, cause_id AS anc, 1 AS depth FROM links UNION ALL SELECT up.node, l.cause_id, up.depth + 1 FROM up JOIN links l ON l.event_id = up.anc),
below AS (SELECT node, arg_max(anc, depth) AS root, max(depth) AS depth FROM up GROUP BY node),
trees AS (SELECT * FROM below UNION ALL SELECT DISTINCT root, root, 0 FROM below)"""
_EVENTS = f"WITH RECURSIVE {_PEAKS}, {_EDGES}, {_LINKS}, {_TREES.removeprefix('RECURSIVE ')}"


def _trees(spark, d):
    return trees(_links(spark, d), "event_id", "cause_id")


def _members(spark, d):
    return _trees(spark, d).join(peaks(spark, d), F.col("node") == F.col("event_id")).select("root", "depth", "event_id", "dataset", "cell", "frame")


@query(f"{_EVENTS} SELECT node AS event_id, root, depth FROM trees")
def sequential_members(spark, d):
    return _trees(spark, d).select(F.col("node").alias("event_id"), "root", "depth")


@query(f"WITH {_PEAKS}, {_EDGES}, {_LINKS} SELECT event_id, CASE WHEN event_id IN (SELECT event_id FROM links) THEN 'caused' WHEN event_id IN (SELECT cause_id FROM links) THEN 'origin' ELSE 'individual' END AS origin_type FROM peaks")
def peak_classification(spark, d):
    links = _links(spark, d)
    # One pass over the links tells both roles; caused wins over origin.
    roles = links.select(F.explode(F.array(F.struct("event_id", F.lit(2).alias("role")), F.struct(F.col("cause_id").alias("event_id"), F.lit(1).alias("role")))).alias("s")).select("s.*")
    role = roles.groupBy("event_id").agg(F.max("role").alias("role"))
    kind = F.when(F.col("role") == 2, "caused").when(F.col("role") == 1, "origin").otherwise("individual")
    return peaks(spark, d).select("event_id").join(role, "event_id", "left").select("event_id", kind.alias("origin_type"))


@query(f"""{_EVENTS} SELECT root, count(*) AS n_peaks, count(DISTINCT cell) AS n_cells, min(frame) AS onset, max(frame) AS last_peak,
CASE WHEN count(DISTINCT cell) >= 10 THEN '10+' ELSE printf('%02d', count(DISTINCT cell)) END AS size_class FROM trees JOIN peaks ON node = event_id GROUP BY root""")
def sequential_events(spark, d):
    n = F.countDistinct("cell")
    out = _members(spark, d).groupBy("root").agg(F.count("*").alias("n_peaks"), n.alias("n_cells"), F.min("frame").alias("onset"), F.max("frame").alias("last_peak"))
    return out.withColumn("size_class", F.when(F.col("n_cells") >= 10, "10+").otherwise(F.lpad(F.col("n_cells").cast("string"), 2, "0")))


@query(f"""{_EVENTS}, level AS (SELECT root, depth, count(*) AS n FROM trees GROUP BY ALL), leaf AS (SELECT root, round(avg(depth), 6) AS mean_path FROM trees WHERE node NOT IN (SELECT cause_id FROM links) GROUP BY root)
SELECT root, CAST(sum(n) AS BIGINT) AS nodes, CAST(sum(n) - 1 AS BIGINT) AS edges, CAST(max(depth) AS BIGINT) AS dag_depth, max(n) AS width, round((sum(n) - 1) / sum(n), 3) AS mean_out_degree, any_value(mean_path) AS mean_path FROM level JOIN leaf USING (root) GROUP BY root""")
def dag_metrics(spark, d):
    t = _trees(spark, d)
    inner = _links(spark, d).select(F.col("cause_id").alias("node")).distinct()
    leaf = t.join(inner, "node", "left_anti").groupBy("root").agg(F.round(F.avg("depth"), 6).alias("mean_path"))
    level = t.groupBy("root", "depth").agg(F.count("*").alias("n"))
    s = F.sum("n")
    out = level.groupBy("root").agg(s.alias("nodes"), (s - 1).alias("edges"), F.max("depth").alias("dag_depth"), F.max("n").alias("width"), F.round((s - 1) / s, 3).alias("mean_out_degree"))
    return out.join(leaf, "root")


@query(f"{_EVENTS}, c AS (SELECT root, frame, count(*) AS n FROM trees JOIN peaks ON node = event_id GROUP BY ALL) SELECT root, frame, CAST(sum(n) OVER (PARTITION BY root ORDER BY frame) AS BIGINT) AS reached FROM c")
def growth_curve(spark, d):
    c = _members(spark, d).groupBy("root", "frame").agg(F.count("*").alias("n"))
    return c.select("root", "frame", F.sum("n").over(Window.partitionBy("root").orderBy("frame")).alias("reached"))


@query(f"{_EVENTS}, c AS (SELECT root, frame, count(*) AS n FROM trees JOIN peaks ON node = event_id GROUP BY ALL), g AS (SELECT root, frame, sum(n) OVER (PARTITION BY root ORDER BY frame) AS reached, sum(n) OVER (PARTITION BY root) AS total, min(frame) OVER (PARTITION BY root) AS onset FROM c) SELECT root, min(frame - onset) AS frames_to_half FROM g WHERE reached >= total / 2 GROUP BY root")
def time_to_half(spark, d):
    g = growth_curve(spark, d)
    total = g.groupBy("root").agg(F.max("reached").alias("total"), F.min("frame").alias("onset"))
    return g.join(total, "root").filter(F.col("reached") >= F.col("total") / 2).groupBy("root").agg(F.min(F.col("frame") - F.col("onset")).alias("frames_to_half"))


@query(f"{_EVENTS}, f AS (SELECT root, cell, min((frame, event_id)) AS spot FROM trees JOIN peaks ON node = event_id GROUP BY ALL), r AS (SELECT root, cell, row_number() OVER (PARTITION BY root ORDER BY spot) AS r, count(*) OVER (PARTITION BY root) AS n FROM f) SELECT root, cell FROM r WHERE r <= greatest(1, n // 4)")
def early_peakers(spark, d):
    f = _members(spark, d).groupBy("root", "cell").agg(F.min(F.struct("frame", "event_id")).alias("at"))
    w = Window.partitionBy("root")
    r = f.select("root", "cell", F.row_number().over(w.orderBy("at")).alias("r"), F.count("*").over(w).alias("n"))
    return r.filter(F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") / 4))).select("root", "cell")


@query(f"{_EVENTS}, f AS (SELECT root, cell, min(frame) AS frame FROM trees JOIN peaks ON node = event_id GROUP BY ALL), c AS (SELECT root, frame, count(*) AS n FROM f GROUP BY ALL) SELECT root, frame, CAST(sum(n) OVER (PARTITION BY root ORDER BY frame) AS BIGINT) AS cells FROM c")
def wavefront(spark, d):
    f = _members(spark, d).groupBy("root", "cell").agg(F.min("frame").alias("frame"))
    c = f.groupBy("root", "frame").agg(F.count("*").alias("n"))
    return c.select("root", "frame", F.sum("n").over(Window.partitionBy("root").orderBy("frame")).alias("cells"))


@query(f"""WITH {_PEAKS}, {_EDGES}, {_LINKS}, k AS (SELECT event_id, cell % 15 - cause_cell % 15 AS dx, cell // 15 - cause_cell // 15 AS dy, lag FROM links)
SELECT event_id, round(sqrt(dx * dx + dy * dy), 6) AS distance, round(sqrt(dx * dx + dy * dy) / lag, 6) AS speed, sqrt(dx * dx + dy * dy) / lag > 0.5 AS fast FROM k""")
def communication_metrics(spark, d):
    dx = F.col("cell") % 15 - F.col("cause_cell") % 15
    dy = F.floor(F.col("cell") / 15) - F.floor(F.col("cause_cell") / 15)
    dist = F.sqrt((dx * dx + dy * dy).cast("double"))
    return _links(spark, d).select("event_id", F.round(dist, 6).alias("distance"), F.round(dist / F.col("lag"), 6).alias("speed"), (dist / F.col("lag") > 0.5).alias("fast"))


@query(f"""WITH {_PEAKS}, {_EDGES}, p AS (SELECT DISTINCT dataset, frame, cell FROM peaks) SELECT a.dataset, a.frame, a.cell AS cell_a, b.cell AS cell_b FROM p a JOIN edges e ON a.cell = e.cell JOIN p b ON b.cell = e.neighbour AND b.dataset = a.dataset AND b.frame = a.frame WHERE a.cell < b.cell""")
def copeaking_pairs(spark, d):
    from tidewave.sources.tables import neighbours

    p = peaks(spark, d).select("dataset", "frame", "cell").distinct()
    e = neighbours(p.select("cell").distinct()).filter("cell < neighbour").select(F.col("cell").alias("cell_a"), F.col("neighbour").alias("cell_b"))
    a = p.withColumnRenamed("cell", "cell_a").join(e, "cell_a")
    return a.join(p.withColumnRenamed("cell", "cell_b"), ["dataset", "frame", "cell_b"]).select("dataset", "frame", "cell_a", "cell_b")


@query(f"""WITH {_PEAKS}, s AS (SELECT *, lead(frame) OVER (PARTITION BY dataset ORDER BY frame, event_id) AS f1 FROM peaks)
SELECT a.dataset, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM peaks b WHERE b.dataset = a.dataset AND b.cell <> a.cell AND b.frame BETWEEN a.frame AND a.frame + 1 AND (b.frame, b.event_id) > (a.frame, a.event_id))) AS synchronous FROM s a GROUP BY a.dataset""")
def synchrony(spark, d):
    # A later peak of another cell within one frame: the least and the greatest cell of the rest of the span tell whether one differs.
    p = peaks(spark, d).select("dataset", "frame", "event_id", "cell")
    same = Window.partitionBy("dataset", "frame").orderBy("event_id").rowsBetween(1, Window.unboundedFollowing)
    span = p.groupBy("dataset", (F.col("frame") - 1).alias("frame")).agg(F.min("cell").alias("lo2"), F.max("cell").alias("hi2"))
    q = p.withColumns({"lo": F.min("cell").over(same), "hi": F.max("cell").over(same)}).join(span, ["dataset", "frame"], "left")
    other = F.coalesce(F.least("lo", "lo2") != F.col("cell"), F.lit(False)) | F.coalesce(F.greatest("hi", "hi2") != F.col("cell"), F.lit(False))
    return q.groupBy("dataset").agg(F.count("*").alias("n"), F.count_if(other).alias("synchronous"))
