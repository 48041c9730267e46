"""Queries that publish the five tables, with their SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions import binning, signals
from tidewave.operators import communications, graph, metrics
from tidewave.operators import spatial as operators
from tidewave.plans import spatial
from tidewave.plans.catalog import _PEAKS, query
from tidewave.plans.traces import _TOPS, _smooth
from tidewave.sources import exports
from tidewave.sources.tables import peaks, table

#: Least prominence of a published peak, share of the cells a wave's activity peak needs, frames of the recording that ids leave room for, and what ids of cascades are above.
PROMINENCE, SHARE, FRAMES, CASCADE = 1.0, 0.4, 100_000, 1_000_000_000_000

_FOUND = f"""{_TOPS}, e AS (SELECT t.cell, t.frame, t.v, coalesce(max(s.frame) FILTER (s.frame < t.frame), -1) AS lo, coalesce(min(s.frame) FILTER (s.frame > t.frame), (SELECT len FROM len)) AS hi FROM tops t LEFT JOIN smooth s ON s.cell = t.cell AND s.v > t.v GROUP BY ALL),
deep AS (SELECT e.cell, e.frame, any_value(e.v) AS v, any_value(e.v) - greatest(min(s.v) FILTER (s.frame <= e.frame), min(s.v) FILTER (s.frame >= e.frame)) AS depth FROM e JOIN smooth s ON s.cell = e.cell AND s.frame > lo AND s.frame < hi GROUP BY e.cell, e.frame),
found AS MATERIALIZED (SELECT CAST(t.cell * {FRAMES} + t.frame AS BIGINT) AS event_id, t.cell, 'all' AS dataset, CAST(t.frame AS BIGINT) AS frame, any_value(t.v) AS height, any_value(depth) AS depth,
  CAST(coalesce(max(s.frame) FILTER (s.frame <= t.frame AND s.v <= t.v - 0.5 * depth), 0) AS BIGINT) AS start, CAST(coalesce(min(s.frame) FILTER (s.frame >= t.frame AND s.v <= t.v - 0.5 * depth), (SELECT len - 1 FROM len)) AS BIGINT) AS stop,
  CAST(coalesce(max(s.frame) FILTER (s.frame <= t.frame AND s.v <= t.v - 0.9 * depth), 0) AS BIGINT) AS base_on, CAST(coalesce(min(s.frame) FILTER (s.frame >= t.frame AND s.v <= t.v - 0.9 * depth), (SELECT len - 1 FROM len)) AS BIGINT) AS base_off
  FROM deep t JOIN smooth s ON s.cell = t.cell WHERE depth >= {PROMINENCE} GROUP BY t.cell, t.frame),
numbered AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY frame) - 1 AS peak_id FROM found)"""
_RECORDED = f"""WITH RECURSIVE {_FOUND}, {spatial._SPOTS.removeprefix(_PEAKS + ', ').replace('placed AS (SELECT p.*, x, y FROM peaks p', 'placed AS (SELECT p.*, x, y FROM found p')}, {spatial._NEAR},
{spatial._WAVES.replace('range(frame, frame + dur + 1)', 'range(start, stop + 1)').replace(f'n >= {spatial.RATIO}', f'n >= {SHARE}')}, rest AS (SELECT * FROM placed WHERE event_id NOT IN (SELECT event_id FROM waves)), {spatial._COMMS.replace('placed', 'rest')}{spatial._EVENTS.removeprefix(spatial._LINKED)},
crew AS MATERIALIZED (SELECT m.*, x, y FROM (SELECT event, cause_id AS id, cause_cell AS cell, cause_frame AS frame FROM ev UNION SELECT event, event_id, cell, frame FROM ev) m JOIN spots USING (cell)),
first_seen AS (SELECT event, cell, min(frame) AS t FROM crew GROUP BY ALL), source AS (SELECT o.event, o.origin_cell AS o_cell, s.x AS ox, s.y AS oy, t AS o_frame FROM origin o JOIN spots s ON s.cell = o.origin_cell JOIN first_seen f ON f.event = o.event AND f.cell = o.origin_cell)"""


@dataclass(frozen=True)
class Recorded:
    """What the published tables are made of, each cut once: cells, detected peaks, waves, links of the rest, cascades with members and origins."""

    cells: DataFrame
    found: DataFrame
    waves: DataFrame
    comms: DataFrame
    links: DataFrame
    members: DataFrame
    source: DataFrame


def recorded(spark, d) -> Recorded:
    """Peaks are detected on the smoothed traces, waves taken out first, then cascades linked among what is left."""
    cells = graph.cut(spatial.spots(spark, d))
    raw = signals.detect(_smooth(spark, d), ["cell"], PROMINENCE, part=0.5, base_part=0.9)
    whole = {n: F.col(c).cast("long") for n, c in (("frame", "frame"), ("start", "onset"), ("stop", "offset"), ("base_on", "base_onset"), ("base_off", "base_offset"), ("peak_id", "peak_id"))}
    found = raw.withColumns(whole).withColumn("event_id", F.col("cell") * FRAMES + F.col("frame")).select("event_id", "peak_id", "cell", F.lit("all").alias("dataset"), "frame", "height", F.col("prominence").alias("depth"), "start", "stop", "base_on", "base_off")
    found = graph.cut(found)
    placed = graph.cut(found.join(cells, "cell"))
    waves = graph.cut(spatial.waves_of(placed, cells, SHARE).join(cells, "cell").withColumnRenamed("event_id", "id"))
    rest = placed.join(waves.select(F.col("id").alias("event_id")), "event_id", "left_anti")
    comms = communications.communications(rest, None, spatial.REACH, spatial.NEAR)
    links = communications.events(comms, spatial.LEAST)
    links = graph.cut(spatial.apart(links, cells).withColumn("distance", F.sqrt("squared")).drop("squared"))
    ends = F.array(F.struct(F.col("cause_id").alias("id"), F.col("cause_cell").alias("cell"), F.col("cause_frame").alias("frame")), F.struct(F.col("event_id").alias("id"), F.col("cell"), F.col("frame")))
    members = graph.cut(links.select("event", F.explode(ends).alias("s")).select("event", "s.*").distinct().join(cells, "cell"))
    seen = members.groupBy("event", F.col("cell").alias("o_cell")).agg(F.min("frame").alias("o_frame"))
    source = communications.origins(links).select("event", F.col("origin_cell").alias("o_cell")).join(seen, ["event", "o_cell"]).join(cells.toDF("o_cell", "ox", "oy"), "o_cell")
    return Recorded(cells, found, waves, comms, links, members, graph.cut(source))


@query(f"""{_RECORDED}, k AS (SELECT n.*, w.event AS wave, w.caused, m.event AS cascade FROM numbered n LEFT JOIN waves w USING (event_id) LEFT JOIN crew m ON m.id = n.event_id)
SELECT peak_id AS "Peak ID", cell AS "Cell ID", CAST(coalesce(wave, cascade + {CASCADE}) AS VARCHAR) AS "Event ID", base_on + 100.0 AS "Baseline onset time (s)", base_off + 100.0 AS "Baseline offset time (s)", CAST(base_off - base_on AS DOUBLE) AS "Baseline duration (s)",
start + 100.0 AS "FHW onset time (s)", stop + 100.0 AS "FHW offset time (s)", CAST(stop - start AS DOUBLE) AS "FHW duration (s)", CAST(frame AS DOUBLE) AS "Peak time (s)", CAST(start AS DOUBLE) AS "Onset time (s)", CAST(stop AS DOUBLE) AS "Offset time (s)", CAST(stop - start AS DOUBLE) AS "Duration (s)", CAST(frame AS DOUBLE) AS "Event reference time (s)",
round(height, 1) AS "Height (noise std units)", round(depth, 1) AS "Prominence (noise std units)", round(height - depth / 2, 1) AS "FHW height (noise std units)", CAST(frame - base_on AS DOUBLE) AS "Baseline rise time (s)", CAST(base_off - frame AS DOUBLE) AS "Baseline decay time (s)",
CAST(frame - start AS DOUBLE) AS "FHW rise time (s)", CAST(stop - frame AS DOUBLE) AS "FHW decay time (s)", CASE WHEN stop > start THEN round(1 - abs((frame - start) - (stop - frame)) / CAST(stop - start AS DOUBLE), 3) END AS "FHW symmetry score",
CASE WHEN wave IS NOT NULL THEN 'global' WHEN cascade IS NOT NULL THEN 'sequential' END AS "In event", CASE WHEN wave IS NOT NULL THEN CASE WHEN caused THEN 'caused' ELSE 'origin' END WHEN event_id IN (SELECT event_id FROM comms) THEN 'caused' WHEN event_id IN (SELECT cause_id FROM comms) THEN 'origin' ELSE 'individual' END AS "Origin type" FROM k""")
def peaks_export(spark, d):
    r = recorded(spark, d)
    roles = r.comms.select(F.explode(F.array(F.struct("event_id", F.lit(2).alias("role")), F.struct(F.col("cause_id").alias("event_id"), F.lit(1).alias("role")))).alias("s")).select("s.*").groupBy("event_id").agg(F.max("role").alias("role"))
    k = r.found.join(r.waves.select(F.col("id").alias("event_id"), F.col("event").alias("wave"), "caused"), "event_id", "left").join(r.members.select(F.col("id").alias("event_id"), F.col("event").alias("cascade")), "event_id", "left").join(roles, "event_id", "left")
    kind = F.when(F.col("wave").isNotNull(), F.when(F.col("caused"), "caused").otherwise("origin")).when(F.col("role") == 2, "caused").when(F.col("role") == 1, "origin").otherwise("individual")
    named = {"event": F.coalesce("wave", F.col("cascade") + CASCADE).cast("string"), "in_event": F.when(F.col("wave").isNotNull(), "global").when(F.col("cascade").isNotNull(), "sequential"), "origin_type": kind}
    return exports.peaks_table(k.withColumns(named).withColumnsRenamed({"start": "on", "stop": "off", "depth": "prominence"}))


@query(f"""{_RECORDED}, base AS (SELECT cell, count(*) AS n, count(*) FILTER (event_id NOT IN (SELECT event_id FROM waves) AND event_id NOT IN (SELECT id FROM crew)) AS alone FROM found GROUP BY cell),
gaps AS (SELECT cell, count(gap) AS n, stddev_pop(gap) AS s, avg(gap) AS m FROM (SELECT cell, frame - lag(frame) OVER (PARTITION BY cell ORDER BY frame) AS gap FROM found) GROUP BY cell),
glo AS (SELECT cell, count(DISTINCT event) AS n FROM waves GROUP BY cell), seq AS (SELECT cell, count(DISTINCT event) AS n FROM crew GROUP BY cell), led AS (SELECT o_cell AS cell, count(*) AS n FROM source GROUP BY 1),
early AS (SELECT cell, count(*) AS n, string_agg(CAST(event AS VARCHAR), ',' ORDER BY event) AS ids FROM (SELECT event, cell, row_number() OVER (PARTITION BY event ORDER BY spot) AS r, count(*) OVER (PARTITION BY event) AS n FROM (SELECT event, cell, min((frame, event_id)) AS spot FROM waves GROUP BY ALL)) WHERE r <= greatest(1, n // 4) GROUP BY cell),
nb AS (SELECT cell, count(*) AS n, string_agg(CAST(neighbour AS VARCHAR), ',' ORDER BY neighbour) AS ids FROM edges GROUP BY cell)
SELECT c.cell AS "Cell ID", round(x * 0.325, 2) AS "Centroid X coordinate (um)", round(y * 0.325, 2) AS "Centroid Y coordinate (um)", coalesce(base.n, 0) AS "Number of peaks", coalesce(base.n, 0) > 0 AS "Is active", coalesce(glo.n, 0) AS "Occurrences in global events",
coalesce(early.n, 0) AS "Occurrences in global events as early peaker", '[' || coalesce(early.ids, '') || ']' AS "Early peaker event IDs", coalesce(seq.n, 0) AS "Occurrences in sequential events", coalesce(led.n, 0) AS "Occurrences in sequential events as origin", coalesce(base.alone, 0) AS "Occurrences in individual events",
round(coalesce(base.n, 0) / (SELECT len FROM len), 6) AS "Peak frequency (Hz)", CASE WHEN gaps.n > 1 THEN round(1 / (1 + gaps.s / nullif(gaps.m, 0)), 4) END AS "Periodicity score", coalesce(nb.n, 0) AS "Neighbor count", '[' || coalesce(nb.ids, '') || ']' AS "Neighbors (labels)"
FROM spots c LEFT JOIN base USING (cell) LEFT JOIN gaps USING (cell) LEFT JOIN glo USING (cell) LEFT JOIN seq USING (cell) LEFT JOIN led USING (cell) LEFT JOIN early USING (cell) LEFT JOIN nb USING (cell)""")
def cells_export(spark, d):
    r = recorded(spark, d)
    inside = r.members.select(F.col("id").alias("event_id")).union(r.waves.select("id")).withColumn("inside", F.lit(1))
    w = Window.partitionBy("cell").orderBy("frame")
    own = r.found.join(inside, "event_id", "left").withColumn("gap", F.col("frame") - F.lag("frame").over(w))
    steady = F.when(F.count("gap") > 1, 1 / (1 + F.stddev_pop("gap") / F.nullif(F.avg("gap"), F.lit(0.0))))
    base = own.groupBy("cell").agg(F.count("*").alias("n_peaks"), F.count_if(F.col("inside").isNull()).alias("n_individual"), steady.alias("periodicity"))
    e = Window.partitionBy("event")
    first = r.waves.groupBy("event", "cell").agg(F.min(F.struct("frame", "id")).alias("at"))
    early = first.withColumns({"r": F.row_number().over(e.orderBy("at")), "n": F.count("*").over(e)}).filter(F.col("r") <= F.greatest(F.lit(1), F.floor(F.col("n") / 4))).groupBy("cell").agg(F.count("*").alias("n_early"), F.collect_list("event").alias("early_events"))
    parts = [
        base, early, r.waves.groupBy("cell").agg(F.countDistinct("event").alias("n_global")), r.members.groupBy("cell").agg(F.countDistinct("event").alias("n_sequential")),
        r.source.groupBy(F.col("o_cell").alias("cell")).agg(F.count("*").alias("n_origin")), operators.neighbour_lists(r.cells, spatial.NEAR).select("cell", "neighbours"),
    ]
    k = r.cells
    for part in parts:
        k = k.join(part, "cell", "left")
    none, frames = F.array().cast("array<long>"), peaks(spark, d).agg((F.max("frame") + 1).alias("frames"))
    k = k.na.fill(0, ["n_peaks", "n_individual", "n_early", "n_global", "n_sequential", "n_origin"]).crossJoin(F.broadcast(frames))
    return exports.cells_table(k.withColumns({"early_events": F.coalesce("early_events", none), "neighbours": F.coalesce("neighbours", none), "frequency": F.col("n_peaks") / F.col("frames")}))


_WAVE_AXIS = """spans AS (SELECT event, min(frame) AS a, max(frame) AS b FROM waves GROUP BY event), bins AS (SELECT event, i, a + i * (b - a + 1) // 6 AS lo, CASE WHEN i = 5 THEN b ELSE a + (i + 1) * (b - a + 1) // 6 - 1 END AS hi FROM spans, (SELECT unnest(range(0, 6)) AS i)),
held AS (SELECT DISTINCT k.event, k.i, g.cell, s.x, s.y FROM bins k JOIN waves g ON g.event = k.event AND g.frame BETWEEN k.lo AND k.hi JOIN spots s ON s.cell = g.cell),
mid AS (SELECT event, i, median(x) AS mx, median(y) AS my FROM held GROUP BY ALL), off AS (SELECT h.*, sqrt((x - mx) ** 2 + (y - my) ** 2) AS r FROM held h JOIN mid USING (event, i)), md AS (SELECT event, i, median(r) AS m FROM off GROUP BY ALL),
bar AS (SELECT o.event, o.i, any_value(m) + 3 * median(abs(r - m)) AS bar FROM off o JOIN md USING (event, i) GROUP BY ALL), com AS (SELECT o.event, o.i, avg(x) AS x, avg(y) AS y FROM off o JOIN bar USING (event, i) WHERE r <= bar + 1e-9 GROUP BY ALL),
points AS (SELECT k.event, k.i, (k.lo + k.hi) / 2.0 AS t, k.hi >= k.lo AS has, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM bins k LEFT JOIN com USING (event, i)), inner_points AS (SELECT * FROM points WHERE i BETWEEN 1 AND 4),
way AS (SELECT event, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS turn, max(x) FILTER (i = 4) - max(x) FILTER (i = 1) AS dx, max(y) FILTER (i = 4) - max(y) FILTER (i = 1) AS dy, max(t) FILTER (i = 4 AND has) - max(t) FILTER (i = 1 AND has) AS dt FROM inner_points GROUP BY event),
wide AS (SELECT a.event, max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS extent FROM held a JOIN held b ON a.event = b.event GROUP BY a.event),
axis AS (SELECT event, CASE WHEN go THEN s * cos(turn) ELSE 0 END AS vx, CASE WHEN go THEN s * sin(turn) ELSE 0 END AS vy, CASE WHEN go AND dt > 0 THEN sqrt(dx * dx + dy * dy) / dt ELSE 0 END AS speed FROM (SELECT *, extent > 0 AND sqrt(dx * dx + dy * dy) >= 0.25 * extent AS go, CASE WHEN cos(turn) * dx + sin(turn) * dy < 0 THEN -1 ELSE 1 END AS s FROM way JOIN wide USING (event)))"""
_GROW = """joint AS (SELECT event + 1000000000000 AS event, id, frame FROM crew UNION ALL SELECT event, event_id, frame FROM waves), reach_span AS (SELECT event, min(frame) AS a, max(frame) AS b FROM joint GROUP BY event),
grow AS (SELECT s.event, s.frame - a AS i, sum(count(m.id)) OVER (PARTITION BY s.event ORDER BY s.frame) AS y FROM (SELECT event, a, unnest(range(a, b + 1)) AS frame FROM reach_span) s LEFT JOIN joint m ON m.event = s.event AND m.frame = s.frame GROUP BY s.event, s.frame, a),
marked AS (SELECT *, max(y) OVER (PARTITION BY event) AS total FROM grow), halves AS (SELECT event, min(i) AS half FROM marked WHERE y >= total / 2.0 GROUP BY event),
growth AS (SELECT event, avg(y) AS gm, stddev_pop(y) AS gs, any_value(half) AS half, 100 * regr_slope(y, i) FILTER (abs(i - half) <= 2) / any_value(total) AS rate FROM marked JOIN halves USING (event) GROUP BY event)"""
_DAG = spatial.ORACLE_DAG
_CASCADES = """cells_of AS (SELECT DISTINCT event, cell, x, y FROM crew), others AS (SELECT c.event, avg(c.x) AS mx, avg(c.y) AS my FROM cells_of c JOIN source o ON o.event = c.event AND o.o_cell <> c.cell GROUP BY c.event),
near_ones AS (SELECT c.event, avg(s.x) AS cx, avg(s.y) AS cy FROM ev c JOIN source o ON o.event = c.event AND o.o_cell = c.cause_cell JOIN spots s ON s.cell = c.cell GROUP BY c.event),
ways AS (SELECT o.event, mx - ox AS dx, my - oy AS dy, sqrt((mx - ox) ** 2 + (my - oy) ** 2) AS size, sqrt((cx - ox) ** 2 + (cy - oy) ** 2) AS bar FROM source o JOIN others USING (event) JOIN near_ones USING (event)),
dir AS (SELECT event, CASE WHEN size > 0 AND size >= 0.5 * bar THEN dx / size ELSE 0 END AS vx, CASE WHEN size > 0 AND size >= 0.5 * bar THEN dy / size ELSE 0 END AS vy FROM ways),
mean_place AS (SELECT event, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy FROM cells_of GROUP BY event), far_out AS (SELECT event, max(sqrt((x - mx) ** 2 + (y - my) ** 2)) AS r FROM cells_of JOIN mean_place USING (event) GROUP BY event),
own AS (SELECT a.event, avg(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS own FROM cells_of a JOIN cells_of b ON a.event = b.event AND a.cell < b.cell GROUP BY a.event), pop AS (SELECT avg(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS pop FROM spots a JOIN spots b ON a.cell < b.cell),
shapes AS (SELECT event, CASE WHEN n < 3 THEN 1 WHEN h - g <= 1e-9 * h THEN NULL ELSE least(sqrt((h + g) / (h - g)), 100) END AS elongation, CASE WHEN n < 3 OR r = 0 THEN 0 ELSE 1 - sqrt((ox - mx) ** 2 + (oy - my) ** 2) / r END AS radiality, own / pop AS compactness
  FROM (SELECT *, (xx + yy) / 2 AS h, sqrt(((xx - yy) / 2) ** 2 + xy ** 2) AS g FROM mean_place) JOIN far_out USING (event) JOIN source USING (event) LEFT JOIN own USING (event), pop),
pace AS (SELECT event, avg(sp) AS cs, stddev_pop(sp) AS css, avg(lag) AS ct, stddev_pop(lag) AS cts FROM (SELECT c.event, c.frame - c.cause_frame AS lag, sqrt(e.squared) / greatest(c.frame - c.cause_frame, 1) AS sp FROM ev c JOIN edges e ON e.cell = c.cause_cell AND e.neighbour = c.cell) GROUP BY event)"""
_VECTOR = "'[' || printf('%.3f', round({0}vx, 3) + 0.0) || ', ' || printf('%.3f', round({0}vy, 3) + 0.0) || ']'"


@query(f"""{_RECORDED}, {_WAVE_AXIS}, {_GROW}, {_DAG}, {_CASCADES},
s AS (SELECT event, min(frame) AS a, max(frame) AS b, count(DISTINCT cell) AS n FROM crew GROUP BY event), g AS (SELECT event, min(frame) AS a, max(frame) AS b, count(DISTINCT cell) AS n FROM waves GROUP BY event),
t AS (SELECT s.event + {CASCADE} AS id, 'SequentialEvent' AS kind, a, b, n, CAST(NULL AS BIGINT) AS peak, {_VECTOR.format('d.')} AS way, CAST(NULL AS DOUBLE) AS speed, n_nodes, n_edges, n_roots, depth, width, mean_out_degree, mean_path, cs, css, ct, cts, elongation, radiality, compactness
  FROM s JOIN dir d USING (event) JOIN dag USING (event) JOIN pace USING (event) JOIN shapes USING (event)
  UNION ALL SELECT g.event, 'GlobalEvent', a, b, n, g.event, {_VECTOR.format('axis.')}, speed, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM g JOIN axis USING (event))
SELECT id AS "Event ID", kind AS "Event type", a + 100.0 AS "Event onset time (s)", b + 100.0 AS "Event offset time (s)", CAST(b - a AS DOUBLE) AS "Event duration (s)", peak + 100.0 AS "Event peak time (s)", n AS "Number of cells involved", way AS "Propagation direction vector", round(speed * 0.325, 2) AS "Propagation speed (um/s)",
round(gm, 2) AS "Growth curve mean", round(gs, 2) AS "Growth curve std", CASE WHEN kind = 'GlobalEvent' THEN CAST(half AS DOUBLE) END AS "Time to 50% (s)", CASE WHEN kind = 'GlobalEvent' THEN round(rate, 1) END AS "Normalized peak rate at 50% (% of peaks/s)", CAST(n_nodes AS DOUBLE) AS "DAG number of nodes", CAST(n_edges AS DOUBLE) AS "DAG number of edges", CAST(n_roots AS DOUBLE) AS "DAG number of roots", CAST(depth AS DOUBLE) AS "DAG depth", CAST(width AS DOUBLE) AS "DAG width",
round(mean_out_degree, 2) AS "DAG average out degree", round(mean_path, 2) AS "DAG average path length", round(cs * 0.325, 2) AS "Average communication speed (um/s)", round(css * 0.325, 2) AS "Standard deviation communication speed (um/s)", round(ct, 2) AS "Average communication time (s)", round(cts, 2) AS "Standard deviation communication time (s)",
round(elongation, 2) AS "Elongation score", round(radiality, 2) + 0.0 AS "Radiality score", round(compactness, 2) AS "Compactness score" FROM t JOIN growth ON growth.event = t.id""")
def events_export(spark, d):
    """Waves and cascades in one table of 27 columns; what only the other kind has is null."""
    r = recorded(spark, d)
    vector = F.format_string("[%.3f, %.3f]", F.round("vx", 3) + 0.0, F.round("vy", 3) + 0.0)
    span = lambda m: m.groupBy("event").agg(F.min("frame").alias("onset"), F.max("frame").alias("last"), F.countDistinct("cell").alias("n_cells"))
    s = span(r.members).withColumn("kind", F.lit("SequentialEvent")).join(metrics.direction(r.members, r.links, r.source).select("event", vector.alias("direction")), "event")
    dag = communications.dag_metrics(r.links.select("event", F.col("cause_cell").alias("a"), F.col("cell").alias("b"))).toDF("event", "nodes", "edges", "roots", "depth", "width", "out_degree", "path")
    dag = dag.withColumns({c: F.col(c).cast("double") for c in ("nodes", "edges", "roots", "depth", "width")})
    other = r.cells.toDF("other", "x2", "y2")
    spread = r.cells.join(other, F.col("cell") < F.col("other")).agg(F.avg(F.sqrt((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2)).alias("pop"))
    slow = metrics.growth(r.members).select("event", "growth_mean", "growth_std")
    for part in (dag, metrics.pace(r.links), metrics.shape(r.members, r.source, spread), slow):
        s = s.join(part, "event")
    s = s.withColumn("radiality", F.round("radiality", 2) + 0.0).withColumn("event", F.col("event") + CASCADE)
    g = span(r.waves).withColumns({"kind": F.lit("GlobalEvent"), "peak": F.col("event")}).join(metrics.wave_axis(r.waves).select("event", vector.alias("direction"), "speed"), "event").join(metrics.growth(r.waves), "event")
    return exports.events_table(s.unionByName(g, allowMissingColumns=True).withColumn("duration", F.col("last") - F.col("onset")))


@query(f"""{_RECORDED}, seen AS (SELECT event, cell, min(frame) AS frame FROM ev GROUP BY ALL), per AS (SELECT event, frame, count(*) AS n FROM seen GROUP BY ALL), whole AS (SELECT event, sum(n) AS total FROM per GROUP BY event), edge_of AS (SELECT event, min(cause_frame) AS t0, max(frame) AS t1 FROM ev GROUP BY event),
early AS (SELECT c.event_id, coalesce(sum(p.n), 0) AS before FROM ev c LEFT JOIN per p ON p.event = c.event AND p.frame < c.frame GROUP BY c.event_id)
SELECT c.event_id AS "Communication ID", c.event + {CASCADE} AS "Event ID", c.cause_cell AS "Origin cell ID", o.peak_id AS "Origin cell peak ID", c.cell AS "Cause cell ID", n.peak_id AS "Cause cell peak ID", CAST(c.cause_frame AS DOUBLE) AS "Start time (s)", CAST(c.frame AS DOUBLE) AS "End time (s)", CAST(c.frame - c.cause_frame AS DOUBLE) AS "Duration (s)",
round(sqrt(e.squared) * 0.325, 2) AS "Distance (um)", round(sqrt(e.squared) / greatest(c.frame - c.cause_frame, 1) * 0.325, 2) AS "Speed (um/s)", round(CASE WHEN t1 > t0 THEN (c.frame - t0) / (t1 - t0) ELSE 0 END, 2) AS "Event time phase (fraction of event duration)", round(CASE WHEN total > 1 THEN before / (total - 1) ELSE 0 END, 2) AS "Event recruitment phase (fraction of involved cells)"
FROM ev c JOIN numbered n ON n.event_id = c.event_id JOIN numbered o ON o.event_id = c.cause_id JOIN edges e ON e.cell = c.cause_cell AND e.neighbour = c.cell JOIN whole USING (event) JOIN edge_of USING (event) JOIN early ON early.event_id = c.event_id""")
def communications_export(spark, d):
    r = recorded(spark, d)
    m = metrics.phases(r.links).join(r.found.select("event_id", F.col("peak_id").alias("cause_peak")), "event_id").join(r.found.select(F.col("event_id").alias("cause_id"), F.col("peak_id").alias("origin_peak")), "cause_id")
    named = {"id": F.col("event_id"), "event": F.col("event") + CASCADE, "start": F.col("cause_frame"), "end": F.col("frame")}
    return exports.communications_table(m.withColumns(named).withColumnsRenamed({"cell": "target"}).withColumnsRenamed({"cause_cell": "origin_cell"}).withColumnsRenamed({"target": "cause_cell"}))


@query(f"""{_RECORDED}, {_DAG}, {_CASCADES}, per AS (SELECT cell, count(*) AS n FROM found GROUP BY cell), gaps AS (SELECT cell, count(gap) AS n, stddev_pop(gap) AS s, avg(gap) AS m FROM (SELECT cell, frame - lag(frame) OVER (PARTITION BY cell ORDER BY frame) AS gap FROM found) GROUP BY cell),
said AS (SELECT c.event, c.frame - c.cause_frame AS t, sqrt(e.squared) / greatest(c.frame - c.cause_frame, 1) AS v FROM ev c JOIN edges e ON e.cell = c.cause_cell AND e.neighbour = c.cell),
u AS (SELECT 'peak_duration' AS metric, CAST(stop - start AS DOUBLE) AS value FROM found UNION ALL SELECT 'peak_prominence', depth FROM found UNION ALL SELECT 'periodicity_score', 1 / (1 + s / nullif(m, 0)) FROM gaps WHERE n > 1
  UNION ALL SELECT 'num_peaks', coalesce(n, 0) FROM spots LEFT JOIN per USING (cell) UNION ALL SELECT 'active_vs_inactive', CASE WHEN n > 0 THEN 1 ELSE 0 END FROM spots LEFT JOIN per USING (cell)
  UNION ALL SELECT 'peak_in_event', CASE WHEN event_id IN (SELECT event_id FROM waves) THEN 1 WHEN event_id IN (SELECT id FROM crew) THEN 2 ELSE 3 END FROM found
  UNION ALL SELECT 'communication_time', t FROM said UNION ALL SELECT 'communication_speed', v FROM said UNION ALL SELECT 'avg_comm_time_per_event', avg(t) FROM said GROUP BY event UNION ALL SELECT 'avg_comm_speed_per_event', avg(v) FROM said GROUP BY event
  UNION ALL SELECT 'elongation_score', elongation FROM shapes UNION ALL SELECT 'radiality_score', radiality FROM shapes UNION ALL SELECT 'dag_max_depth', depth FROM dag UNION ALL SELECT 'sequential_n_cells', count(DISTINCT cell) FROM crew GROUP BY event UNION ALL SELECT 'global_n_cells', count(DISTINCT cell) FROM waves GROUP BY event)
SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) + 0.0 AS lo, round(max(value), 6) AS hi, count(value) AS n FROM u WHERE value IS NOT NULL GROUP BY metric""")
def population_distributions(spark, d):
    """The fifteen distributions of a population: of peaks and cells, of cascades and of waves; labels are encoded as numbers (1 global, 2 sequential, 3 none)."""
    r = recorded(spark, d)
    w = Window.partitionBy("cell").orderBy("frame")
    tag = r.waves.select(F.col("id").alias("event_id"), F.lit(1).alias("tag")).union(r.members.select("id", F.lit(2)))
    gaps = r.found.withColumn("gap", F.col("frame") - F.lag("frame").over(w)).groupBy("cell").agg(F.count("*").alias("peaks"), F.when(F.count("gap") > 1, 1 / (1 + F.stddev_pop("gap") / F.nullif(F.avg("gap"), F.lit(0.0)))).alias("steady"))
    cells = r.cells.select("cell").join(gaps, "cell", "left")
    spread = r.cells.join(r.cells.toDF("other", "x2", "y2"), F.col("cell") < F.col("other")).agg(F.avg(F.sqrt((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2)).alias("pop"))
    shapes, pace = metrics.shape(r.members, r.source, spread), metrics.pace(r.links)
    lag = F.col("frame") - F.col("cause_frame")
    depth = communications.dag_metrics(r.links.select("event", F.col("cause_cell").alias("a"), F.col("cell").alias("b")))
    wide = lambda rows, **named: rows.select(*[c.cast("double").alias(n) for n, c in named.items()]).unpivot([], list(named), "metric", "value")
    n_cells = F.countDistinct("cell").alias("n")
    parts = [
        wide(r.found, peak_duration=F.col("stop") - F.col("start"), peak_prominence=F.col("depth")), wide(r.found.join(tag, "event_id", "left"), peak_in_event=F.coalesce("tag", F.lit(3))),
        wide(cells, periodicity_score=F.col("steady"), num_peaks=F.coalesce("peaks", F.lit(0)), active_vs_inactive=(F.coalesce("peaks", F.lit(0)) > 0).cast("int")),
        wide(r.links, communication_time=lag, communication_speed=F.col("distance") / F.greatest(lag, F.lit(1))), wide(pace, avg_comm_time_per_event=F.col("com_time"), avg_comm_speed_per_event=F.col("com_speed")),
        wide(shapes, elongation_score=F.col("elongation"), radiality_score=F.col("radiality")), wide(depth, dag_max_depth=F.col("depth")), wide(r.members.groupBy("event").agg(n_cells), sequential_n_cells=F.col("n")), wide(r.waves.groupBy("event").agg(n_cells), global_n_cells=F.col("n")),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    out = binning.distribution(every.filter("value IS NOT NULL"), ["metric"], "value")
    return out.select("metric", "mean", "std", (F.round("lo", 6) + 0.0).alias("lo"), F.round("hi", 6).alias("hi"), "n")


@query("""SELECT n_name AS path, CAST(n_nationkey AS VARCHAR) AS date, 'IS' || n_regionkey AS image_sequence, r_name AS experiment_type, n_nationkey || '_IS' || n_regionkey || '_' || r_name AS dataset FROM nation JOIN region ON n_regionkey = r_regionkey""")
def experiments_export(spark, d):
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("experiment_type"))
    s = table(spark, d, "nation").join(F.broadcast(r), "n_regionkey")
    s = s.select(F.col("n_name").alias("path"), F.col("n_nationkey").cast("string").alias("date"), F.concat(F.lit("IS"), F.col("n_regionkey").cast("string")).alias("image_sequence"), "experiment_type", F.lit(None).cast("string").alias("condition"))
    return exports.experiments_table(s).drop("condition")


@query("""SELECT l_orderkey, l_linenumber, dataset, n_name FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN 'first' ELSE 'second' END AS dataset FROM lineitem WHERE l_returnflag IN ('A', 'R')) JOIN (SELECT 'first' AS dataset, 'FRANCE' AS n_name UNION ALL SELECT 'second', 'GERMANY') USING (dataset)""")
def merged_datasets(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    parts = {"first": rows.filter("l_returnflag = 'A'").drop("l_returnflag"), "missing": None, "second": rows.filter("l_returnflag = 'R'").drop("l_returnflag")}
    return exports.merge(parts, spark.createDataFrame([("first", "FRANCE"), ("second", "GERMANY")], "dataset string, n_name string"))
