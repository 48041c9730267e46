"""Queries on population-wide events, co-peaking groups, event geometry and participation, with their SQL.

The population is all cells of all datasets. A global event lies between two valleys of the activity trace around a peak that 0.4 of the
cells or more take part in; the frame of the second valley belongs to the next window, so no peak is in two windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions import binning, stats
from tidewave.operators import graph, joins
from tidewave.plans.catalog import _EDGES, _LINKS, _PEAKS, _links, query, rows_only
from tidewave.plans.events import _EVENTS, _members
from tidewave.sources.tables import neighbours, peaks

#: Share of the cells a peak of the activity needs, frames and distance between a peak and what it causes, cells of an event.
RATIO, LAG, RADIUS, CELLS = 0.4, 6, 20, 3

_ACTIVITY = """pooled AS (SELECT f AS frame, count(DISTINCT cell) AS n FROM (SELECT cell, unnest(range(frame, frame + dur + 1)) AS f FROM peaks) GROUP BY f),
dense AS (SELECT s.frame, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, (SELECT max(frame) FROM pooled) + 1)) AS frame) s LEFT JOIN pooled USING (frame)),
runs AS (SELECT any_value(n) AS n, min(frame) AS a, max(frame) AS b FROM (SELECT *, sum(new) OVER (ORDER BY frame) AS run FROM (SELECT *, CASE WHEN n = lag(n) OVER (ORDER BY frame) THEN 0 ELSE 1 END AS new FROM dense)) GROUP BY run),
turns AS (SELECT * FROM (SELECT *, coalesce(n > lag(n) OVER w, false) AS up, coalesce(n > lead(n) OVER w, false) AS down, lag(n) OVER w IS NULL AS first, lead(n) OVER w IS NULL AS last FROM runs WINDOW w AS (ORDER BY a)) WHERE up = down OR first OR last),
bumps AS (SELECT *, lag((a + b) // 2) OVER (ORDER BY a) AS start_frame, lead((a + b) // 2) OVER (ORDER BY a) AS end_frame FROM turns),
wins AS (SELECT (a + b) // 2 AS peak_frame, n AS height, start_frame, end_frame FROM bumps WHERE up AND down AND n >= 0.4 * (SELECT count(DISTINCT cell) FROM peaks))"""
_NEAR = """spots AS (SELECT DISTINCT cell, 10 * (cell % 15) AS x, 10 * (cell // 15) AS y FROM peaks),
near AS (SELECT a.cell, b.cell AS other FROM spots a JOIN spots b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 400)"""
_GLOBAL = f"""{_PEAKS}, {_ACTIVITY}, {_NEAR}, inside AS (SELECT p.*, w.peak_frame AS event FROM wins w JOIN peaks p ON p.frame >= w.start_frame AND p.frame < w.end_frame),
hops AS (SELECT p.event_id AS p_id, q.event_id AS q_id FROM inside p JOIN near ON near.cell = p.cell JOIN inside q ON q.cell = near.other AND q.event = p.event AND q.frame > p.frame AND q.frame <= p.frame + 6),
chosen AS (SELECT event, event_id, cell, frame, event_id IN (SELECT q_id FROM hops) AS caused FROM inside WHERE event_id IN (SELECT p_id FROM hops UNION SELECT q_id FROM hops)),
globals AS (SELECT * FROM chosen WHERE event IN (SELECT event FROM chosen GROUP BY event HAVING count(DISTINCT cell) >= 3))"""


def _activity(p: DataFrame) -> DataFrame:
    active = p.select("cell", F.explode(F.sequence("frame", F.col("frame") + F.col("dur"))).alias("frame"))
    return active.groupBy("frame").agg(F.countDistinct("cell").alias("n"))


def _turns(trace: DataFrame) -> DataFrame:
    """Level runs of a trace (frame, n) that are a peak, a valley or an end, in order. One row a frame of the recording goes through one window."""
    spark, end = trace.sparkSession, trace.agg(F.max("frame").alias("m"))
    spine = F.broadcast(end).select(F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("frame"))
    dense = spine.join(trace, "frame", "left").select("frame", F.coalesce("n", F.lit(0)).alias("n"))
    w = Window.orderBy("frame")
    marked = dense.withColumn("new", F.when(F.col("n") == F.lag("n").over(w), 0).otherwise(1)).withColumn("run", F.sum("new").over(w))
    runs = marked.groupBy("run").agg(F.first("n").alias("n"), F.min("frame").alias("a"), F.max("frame").alias("b"))
    v = Window.orderBy("a")
    before, after = F.lag("n").over(v), F.lead("n").over(v)
    flags = {"up": F.coalesce(F.col("n") > before, F.lit(False)), "down": F.coalesce(F.col("n") > after, F.lit(False)), "edge": before.isNull() | after.isNull()}
    return runs.withColumns(flags).filter("up = down OR edge")


def activity_windows_of(p: DataFrame, ratio: float = RATIO) -> DataFrame:
    """(peak_frame, height, start_frame, end_frame) of activity peaks that ``ratio`` of the cells take part in."""
    w, mid = Window.orderBy("a"), F.expr("(a + b) div 2")
    bumps = _turns(_activity(p)).withColumns({"start_frame": F.lag(mid).over(w), "end_frame": F.lead(mid).over(w)})
    total = p.agg(F.countDistinct("cell").alias("cells"))
    high = bumps.filter("up AND down").crossJoin(F.broadcast(total)).filter(F.col("n") >= ratio * F.col("cells"))
    return high.select(mid.alias("peak_frame"), F.col("n").alias("height"), "start_frame", "end_frame")


def near_cells(cells: DataFrame, reach: int, columns: int = 15) -> DataFrame:
    """(cell, other) within ``reach`` grid steps (Euclid), the cell itself included. Each cell makes a bounded number of candidates."""
    steps = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if i * i + j * j <= reach * reach]
    x, y = F.col("cell") % columns, F.floor(F.col("cell") / columns)
    near = cells.select("cell", x.alias("x"), y.alias("y"), F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i, j in steps])).alias("s"))
    near = near.filter((F.col("x") + F.col("s.dx")).between(0, columns - 1) & (F.col("y") + F.col("s.dy") >= 0))
    near = near.select("cell", ((F.col("y") + F.col("s.dy")) * columns + F.col("x") + F.col("s.dx")).cast("long").alias("other"))
    return near.join(cells.select(F.col("cell").alias("other")), "other", "left_semi").select("cell", "other")


def global_members(p: DataFrame, ratio: float = RATIO, lag: int = LAG, radius: int = RADIUS, least: int = CELLS) -> DataFrame:
    """(event, event_id, cell, frame, caused) of the peaks of global events.

    A member has a follower or a predecessor: a peak of its window at most ``radius`` away and at most ``lag`` frames later or earlier. What is
    reachable from such peaks are such peaks, so no closure is computed. Only the next and the last frame of each near cell are looked at.
    """
    w = F.broadcast(activity_windows_of(p, ratio))
    inside = p.join(w, (F.col("frame") >= F.col("start_frame")) & (F.col("frame") < F.col("end_frame"))).select(F.col("peak_frame").alias("event"), "event_id", "cell", "frame")
    frames = inside.select("event", F.col("cell").alias("other"), F.col("frame").alias("at"), F.explode(F.array(*[F.floor(F.col("frame") / lag) + i for i in (-1, 0, 1)])).alias("slot")).distinct()
    asked = inside.withColumn("slot", F.floor(F.col("frame") / lag)).join(near_cells(p.select("cell").distinct(), radius // 10), "cell")
    gap = F.col("at") - F.col("frame")
    met = asked.join(frames, ["event", "other", "slot"]).filter((F.abs(gap) <= lag) & (gap != 0))
    flags = met.groupBy("event", "event_id", "cell", "frame").agg(F.bool_or(gap < 0).alias("caused"))
    large = flags.groupBy("event").agg(F.countDistinct("cell").alias("c")).filter(F.col("c") >= least).select("event")
    return flags.join(F.broadcast(large), "event", "left_semi")


def _globals(spark, d):
    return global_members(peaks(spark, d))


@query(f"WITH {_PEAKS}, {_ACTIVITY} SELECT peak_frame, height, start_frame, end_frame FROM wins")
def activity_peaks(spark, d):
    return activity_windows_of(peaks(spark, d))


@query(f"""WITH {_PEAKS}, {_NEAR} SELECT p.event_id AS a_id, q.event_id AS b_id, q.frame - p.frame AS lag FROM peaks p JOIN near ON near.cell = p.cell JOIN peaks q ON q.cell = near.other AND q.dataset = p.dataset AND q.frame > p.frame AND q.frame <= p.frame + 6""")
def theta_join(spark, d):
    p = peaks(spark, d).select("event_id", "cell", "dataset", "frame")
    a = p.select(F.col("event_id").alias("a_id"), "cell", "dataset", F.col("frame").alias("f"), (F.col("frame") + 1).alias("lo"), (F.col("frame") + LAG).alias("hi")).join(near_cells(p.select("cell").distinct(), 2), "cell")
    b = p.select(F.col("event_id").alias("b_id"), F.col("cell").alias("other"), "dataset", "frame")
    return joins.range_join(a, b, ["other", "dataset"], "lo", "hi", "frame", LAG).select("a_id", "b_id", (F.col("frame") - F.col("f")).alias("lag"))


@query(f"WITH {_GLOBAL} SELECT event, event_id, cell, CASE WHEN caused THEN 'caused' ELSE 'origin' END AS origin_type FROM globals")
def global_event_members(spark, d):
    return _globals(spark, d).select("event", "event_id", "cell", F.when(F.col("caused"), "caused").otherwise("origin").alias("origin_type"))


@query(f"WITH {_GLOBAL} SELECT event, count(*) AS n_peaks, count(DISTINCT cell) AS n_cells, min(frame) AS onset, max(frame) AS last_peak, count(*) FILTER (NOT caused) AS n_origins FROM globals GROUP BY event")
def global_events(spark, d):
    return _globals(spark, d).groupBy("event").agg(F.count("*").alias("n_peaks"), F.countDistinct("cell").alias("n_cells"), F.min("frame").alias("onset"), F.max("frame").alias("last_peak"), F.count_if(~F.col("caused")).alias("n_origins"))


@query(f"""WITH {_GLOBAL}, s AS (SELECT peak_frame AS event, unnest(range(start_frame, end_frame)) AS frame FROM wins WHERE peak_frame IN (SELECT event FROM globals))
SELECT s.event, s.frame, count(g.event_id) AS n_peaks FROM s LEFT JOIN globals g ON g.event = s.event AND g.frame = s.frame GROUP BY ALL""")
def global_framewise(spark, d):
    p = peaks(spark, d)
    counts = _globals(spark, d).groupBy("event", "frame").agg(F.count("*").alias("n"))
    spine = activity_windows_of(p).select(F.col("peak_frame").alias("event"), F.explode(F.sequence("start_frame", F.col("end_frame") - 1)).alias("frame"))
    spine = spine.join(counts.select("event").distinct(), "event", "left_semi")
    return spine.join(counts, ["event", "frame"], "left").select("event", "frame", F.coalesce("n", F.lit(0)).alias("n_peaks"))


_REST = f"""WITH RECURSIVE {_GLOBAL}, {_EDGES}, rest AS (SELECT * FROM peaks WHERE event_id NOT IN (SELECT event_id FROM globals)),
{_LINKS.replace('FROM peaks p', 'FROM rest p').replace('JOIN peaks q', 'JOIN rest q')}"""


def _rest(spark, d):
    p = peaks(spark, d)
    return p.join(_globals(spark, d).select("event_id"), "event_id", "left_anti")


@query(f"""{_REST}, up AS (SELECT event_id AS node, cause_id AS anc, 1 AS depth FROM links UNION ALL SELECT up.node, l.cause_id, up.depth + 1 FROM up JOIN links l ON l.event_id = up.anc),
roots AS (SELECT node, arg_max(anc, depth) AS root FROM up GROUP BY node UNION ALL SELECT DISTINCT cause_id, cause_id FROM links WHERE cause_id NOT IN (SELECT event_id FROM links))
SELECT p.event_id, CASE WHEN g.event_id IS NOT NULL THEN 'global' WHEN r.node IS NOT NULL THEN 'sequential' ELSE 'none' END AS in_event, coalesce(g.event, r.root, -1) AS event_key FROM peaks p LEFT JOIN globals g USING (event_id) LEFT JOIN roots r ON r.node = p.event_id""")
def event_assignment(spark, d):
    """Global events come first; sequential ones are made of what is left."""
    p, g = peaks(spark, d), graph.cut(_globals(spark, d))
    rest = p.join(g.select("event_id"), "event_id", "left_anti")
    links = joins.farthest_back(rest, neighbours(p.select("cell").distinct()), 15)
    roots = graph.trees(links, "event_id", "cause_id").select(F.col("node").alias("event_id"), "root")
    kind = F.when(F.col("event").isNotNull(), "global").when(F.col("root").isNotNull(), "sequential").otherwise("none")
    return p.select("event_id").join(g.select("event_id", "event"), "event_id", "left").join(roots, "event_id", "left").select("event_id", kind.alias("in_event"), F.coalesce("event", "root", F.lit(-1)).alias("event_key"))


@query(f"WITH {_GLOBAL} SELECT event_id, dataset, cell, frame FROM peaks WHERE event_id NOT IN (SELECT event_id FROM globals)")
def peaks_without_global(spark, d):
    return _rest(spark, d).select("event_id", "dataset", "cell", "frame")


_COPEAK = f"""{_PEAKS}, {_EDGES}, pairs AS (SELECT p.event_id AS a, q.event_id AS b FROM peaks p JOIN edges e ON e.cell = p.cell JOIN peaks q ON q.cell = e.neighbour AND q.dataset = p.dataset AND q.frame = p.frame),
reach AS (SELECT a AS node, b AS other FROM pairs UNION SELECT r.node, p.b FROM reach r JOIN pairs p ON p.a = r.other), groups AS (SELECT node AS event_id, least(node, min(other)) AS grp FROM reach GROUP BY node)"""


def _copeak_links(p: DataFrame) -> DataFrame:
    q = p.select("event_id", "cell", "dataset", "frame")
    e = neighbours(q.select("cell").distinct())
    b = q.select(F.col("event_id").alias("b"), F.col("cell").alias("neighbour"), "dataset", "frame")
    return q.join(e, "cell").join(b, ["neighbour", "dataset", "frame"]).select(F.col("event_id").alias("a"), "b")


@query(f"WITH RECURSIVE {_COPEAK} SELECT event_id, grp FROM groups")
def copeak_groups(spark, d):
    return graph.connected(_copeak_links(peaks(spark, d))).select(F.col("node").alias("event_id"), F.col("label").alias("grp"))


@query(f"WITH RECURSIVE {_COPEAK} SELECT p.frame, grp, cell FROM groups JOIN peaks p USING (event_id)")
def copeak_groups_at(spark, d):
    return copeak_groups(spark, d).join(peaks(spark, d), "event_id").select("frame", "grp", "cell")


_ORIGINS = """cand AS (SELECT g.grp, q.event_id AS origin_id, q.frame, q.cell FROM groups g JOIN peaks p USING (event_id) JOIN edges e ON e.cell = p.cell JOIN peaks q ON q.cell = e.neighbour AND q.dataset = p.dataset AND q.frame > p.frame - 15 AND q.frame < p.frame),
outer_ones AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM groups g JOIN peaks p USING (event_id) WHERE g.grp = c.grp AND p.cell = c.cell)),
origins AS (SELECT grp, origin_id FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY frame, cell, origin_id) AS r FROM outer_ones) WHERE r = 1)"""


@query(f"WITH RECURSIVE {_COPEAK}, {_ORIGINS} SELECT grp, origin_id FROM origins")
def external_origins(spark, d):
    return _origins(spark, d)[1]


def _origins(spark, d):
    p = peaks(spark, d)
    groups = graph.cut(copeak_groups(spark, d))
    members = groups.join(p.select("event_id", "cell", "dataset", "frame"), "event_id")
    asked = members.join(neighbours(p.select("cell").distinct()), "cell").select("grp", "neighbour", "dataset", (F.col("frame") - 14).alias("lo"), (F.col("frame") - 1).alias("hi")).distinct()
    other = p.select(F.col("event_id").alias("origin_id"), F.col("cell").alias("neighbour"), "dataset", "frame")
    met = joins.range_join(asked, other, ["neighbour", "dataset"], "lo", "hi", "frame", 15)
    outer = met.join(members.select("grp", F.col("cell").alias("neighbour")).distinct(), ["grp", "neighbour"], "left_anti")
    best = outer.groupBy("grp").agg(F.min(F.struct("frame", "neighbour", "origin_id")).alias("b")).select("grp", "b.origin_id")
    return members, graph.cut(best)


@query(f"""WITH RECURSIVE {_COPEAK}, {_ORIGINS}, direct AS (SELECT DISTINCT g.event_id FROM origins o JOIN peaks q ON q.event_id = o.origin_id JOIN groups g ON g.grp = o.grp JOIN peaks p ON p.event_id = g.event_id JOIN edges e ON e.cell = p.cell AND e.neighbour = q.cell),
roots AS (SELECT event_id AS node FROM direct UNION SELECT min(event_id) FROM groups WHERE grp NOT IN (SELECT grp FROM origins) GROUP BY grp),
walk AS (SELECT node, 0 AS level FROM roots UNION SELECT p.b, w.level + 1 FROM walk w JOIN pairs p ON p.a = w.node WHERE w.level < 12), lev AS (SELECT node, min(level) AS level FROM walk GROUP BY node)
SELECT lev.node AS event_id, CAST(lev.level AS BIGINT) AS level, coalesce(min(o.node), -1) AS parent FROM lev LEFT JOIN pairs p ON p.b = lev.node LEFT JOIN lev o ON o.node = p.a AND o.level = lev.level - 1 GROUP BY 1, 2""")
def copeak_levels(spark, d):
    """Breadth-first levels of each group from the members an external origin reaches, or from its first member if it has none."""
    p = peaks(spark, d)
    members, origins = _origins(spark, d)
    origin_cells = origins.join(p.select(F.col("event_id").alias("origin_id"), F.col("cell").alias("neighbour")), "origin_id")
    e = neighbours(p.select("cell").distinct())
    direct = members.join(origin_cells, "grp").join(e, ["cell", "neighbour"], "left_semi").select(F.col("event_id").alias("node")).distinct()
    lone = members.join(origins, "grp", "left_anti").groupBy("grp").agg(F.min("event_id").alias("node")).select("node")
    return graph.levels(direct.union(lone).distinct(), graph.cut(_copeak_links(p))).select(F.col("node").alias("event_id"), "level", F.coalesce("parent", F.lit(-1)).alias("parent"))


@rows_only
def link_components(spark, d):
    """Components over links and co-peaking pairs, where a peak may have many causes. The closure in SQL is quadratic; a test compares with union-find."""
    p = peaks(spark, d)
    links = _links(spark, d).select(F.col("event_id").alias("a"), F.col("cause_id").alias("b")).union(_copeak_links(p))
    return graph.connected(links).select(F.col("node").alias("event_id"), F.col("label").alias("component"))


@query(f"WITH {_PEAKS}, {_EDGES}, kept AS (SELECT cell FROM peaks GROUP BY cell HAVING count(*) >= 66) SELECT cell, neighbour FROM edges WHERE cell IN (SELECT cell FROM kept) AND neighbour IN (SELECT cell FROM kept)")
def induced_subgraph(spark, d):
    p = peaks(spark, d)
    kept = p.groupBy("cell").count().filter("count >= 66").select("cell")
    e = neighbours(p.select("cell").distinct())
    return e.join(kept, "cell", "left_semi").join(kept.withColumnRenamed("cell", "neighbour"), "neighbour", "left_semi").select("cell", "neighbour")


@query(f"WITH {_PEAKS}, s AS (SELECT unnest(range(0, (SELECT max(frame) FROM peaks) + 1)) AS frame) SELECT s.frame, count(DISTINCT cell) AS n_cells FROM s LEFT JOIN peaks USING (frame) GROUP BY 1")
def impulse_trace(spark, d):
    p = peaks(spark, d)
    counts = p.groupBy("frame").agg(F.countDistinct("cell").alias("n"))
    spine = counts.agg(F.max("frame").alias("m")).select(F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("frame"))
    return spine.join(counts, "frame", "left").select("frame", F.coalesce("n", F.lit(0)).alias("n_cells"))


_LINKED = f"""{_EVENTS}, ev AS (SELECT t.root, t.node AS event_id, t.depth, p.cell, p.frame, 10.0 * (p.cell % 15) AS x, 10.0 * (p.cell // 15) AS y FROM trees t JOIN peaks p ON t.node = p.event_id),
cells_of AS (SELECT DISTINCT root, cell, x, y FROM ev), origin AS (SELECT root, cell AS o_cell, x AS ox, y AS oy, frame AS o_frame FROM ev WHERE depth = 0), com AS (SELECT e.*, l.cause_id, q.frame AS cause_frame, q.cell AS cause_cell FROM ev e JOIN links l ON l.event_id = e.event_id JOIN peaks q ON q.event_id = l.cause_id)"""


def _placed(spark, d) -> DataFrame:
    return _members(spark, d).withColumns({"x": 10.0 * (F.col("cell") % 15), "y": 10.0 * F.floor(F.col("cell") / 15)})


def _cells_of(m: DataFrame) -> DataFrame:
    return m.select("root", "cell", "x", "y").distinct()


def _origin(m: DataFrame) -> DataFrame:
    return m.filter("depth = 0").select("root", F.col("cell").alias("o_cell"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("frame").alias("o_frame"))


@query(f"""{_LINKED}, f AS (SELECT root, cell, min(frame) AS first FROM com GROUP BY ALL), span AS (SELECT root, min(cause_frame) AS t0, max(frame) AS t1 FROM com GROUP BY root), r AS (SELECT root, first, sum(count(*)) OVER (PARTITION BY root ORDER BY first) - count(*) AS before, sum(count(*)) OVER (PARTITION BY root) AS total FROM f GROUP BY root, first)
SELECT c.event_id, round(CASE WHEN t1 > t0 THEN (c.frame - t0) / (t1 - t0) ELSE 0 END, 6) AS time_phase, round(CASE WHEN max(total) > 1 THEN coalesce(max(before + n) FILTER (r.first < c.frame), 0) / (max(total) - 1) ELSE 0 END, 6) AS recruitment_phase
FROM com c JOIN span USING (root) JOIN (SELECT r.*, k.n FROM r JOIN (SELECT root, first, count(*) AS n FROM f GROUP BY ALL) k USING (root, first)) r USING (root) GROUP BY c.event_id, c.frame, t0, t1""")
def event_phases(spark, d):
    m = _members(spark, d).select("root", "event_id", "cell", "frame")
    com = _links(spark, d).select("event_id", (F.col("frame") - F.col("lag")).alias("cause_frame")).join(m, "event_id")
    w = Window.partitionBy("root")
    # A cell's first row in its event counts as one recruit; the running sum up to the frame before is what came earlier.
    first = com.groupBy("root", "cell").agg(F.min("frame").alias("frame")).groupBy("root", "frame").agg(F.count("*").alias("n"))
    steps = com.select("root", "frame").distinct().join(first, ["root", "frame"], "left")
    steps = steps.withColumns({"before": F.coalesce(F.sum("n").over(w.orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("n").over(w)})
    span = com.groupBy("root").agg(F.min("cause_frame").alias("t0"), F.max("frame").alias("t1"))
    out = com.join(steps.drop("n"), ["root", "frame"]).join(span, "root")
    time = F.when(F.col("t1") > F.col("t0"), (F.col("frame") - F.col("t0")) / (F.col("t1") - F.col("t0"))).otherwise(0.0)
    recruit = F.when(F.col("total") > 1, F.col("before") / (F.col("total") - 1)).otherwise(0.0)
    return out.select("event_id", F.round(time, 6).alias("time_phase"), F.round(recruit, 6).alias("recruitment_phase"))


@query(f"{_LINKED}, f AS (SELECT root, cell, min(frame) AS frame FROM ev GROUP BY ALL) SELECT DISTINCT a.root, a.frame, (SELECT string_agg(CAST(b.cell AS VARCHAR), ',' ORDER BY b.cell) FROM f b WHERE b.root = a.root AND b.frame <= a.frame) AS cells FROM f a")
def wavefront_cells(spark, d):
    f = _members(spark, d).groupBy("root", "cell").agg(F.min("frame").alias("frame")).groupBy("root", "frame").agg(F.collect_list("cell").alias("new"))
    upto = F.flatten(F.collect_list("new").over(Window.partitionBy("root").orderBy("frame")))
    return f.select("root", "frame", F.array_join(F.array_sort(upto), ",").alias("cells"))


_GROWTH = """span AS (SELECT root, min(frame) AS a, max(frame) AS b FROM ev GROUP BY root), spine AS (SELECT root, a, unnest(range(a, b + 1)) AS frame FROM span),
grow AS (SELECT s.root, s.frame - a AS i, sum(count(e.event_id)) OVER (PARTITION BY s.root ORDER BY s.frame) AS y FROM spine s LEFT JOIN ev e ON e.root = s.root AND e.frame = s.frame GROUP BY s.root, s.frame, a)"""


def _growth(spark, d) -> DataFrame:
    """(root, i, y): peaks reached at each frame since the onset, frames without a peak included."""
    m = _members(spark, d)
    spine = m.groupBy("root").agg(F.min("frame").alias("a"), F.max("frame").alias("b")).select("root", "a", F.explode(F.sequence("a", "b")).alias("frame"))
    n = m.groupBy("root", "frame").agg(F.count("*").alias("n"))
    return spine.join(n, ["root", "frame"], "left").select("root", (F.col("frame") - F.col("a")).alias("i"), F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("root").orderBy("frame")).alias("y"))


@query(f"{_LINKED}, {_GROWTH} SELECT root, round(avg(y), 6) AS mean_reached, round(stddev_pop(y), 6) AS std_reached FROM grow GROUP BY root")
def growth_stats(spark, d):
    return _growth(spark, d).groupBy("root").agg(F.round(F.avg("y"), 6).alias("mean_reached"), F.round(F.stddev_pop("y"), 6).alias("std_reached"))


@query(f"""{_LINKED}, {_GROWTH}, h AS (SELECT root, max(y) AS total, min(i) FILTER (y >= t / 2.0) AS half FROM (SELECT *, max(y) OVER (PARTITION BY root) AS t FROM grow) GROUP BY root)
SELECT root, CAST(any_value(half) AS BIGINT) AS half_frame, round(100 * regr_slope(y, i) / any_value(total), 6) AS rate FROM grow JOIN h USING (root) WHERE i BETWEEN half - 2 AND half + 2 GROUP BY root""")
def growth_rate(spark, d):
    g = _growth(spark, d)
    w = Window.partitionBy("root")
    marked = g.withColumn("total", F.max("y").over(w)).withColumn("half", F.min(F.when(F.col("y") >= F.col("total") / 2, F.col("i"))).over(w))
    near = marked.filter(F.abs(F.col("i") - F.col("half")) <= 2)
    return near.groupBy("root").agg(F.first("half").alias("half_frame"), F.round(100 * F.regr_slope("y", "i") / F.first("total"), 6).alias("rate"))


_DIRECTION = """others AS (SELECT c.root, avg(c.x) AS mx, avg(c.y) AS my FROM cells_of c JOIN origin o ON o.root = c.root AND o.o_cell <> c.cell GROUP BY c.root),
near_ones AS (SELECT c.root, avg(c.x) AS cx, avg(c.y) AS cy FROM com c JOIN origin o ON o.root = c.root AND o.o_cell = c.cause_cell GROUP BY c.root),
way AS (SELECT o.*, mx - ox AS dx, my - oy AS dy, sqrt((mx - ox) ** 2 + (my - oy) ** 2) AS size, sqrt((cx - ox) ** 2 + (cy - oy) ** 2) AS bar FROM origin o JOIN others USING (root) JOIN near_ones USING (root)),
dir AS (SELECT *, CASE WHEN size > 0 AND size >= 0.5 * bar THEN dx / size ELSE 0 END AS vx, CASE WHEN size > 0 AND size >= 0.5 * bar THEN dy / size ELSE 0 END AS vy FROM way)"""


def _direction(spark, d, m: DataFrame) -> DataFrame:
    """Unit vector from the origin to the mean place of the other cells; zero if that lies nearer than half the mean of what the origin caused."""
    o = _origin(m)
    others = _cells_of(m).join(o.select("root", "o_cell"), "root").filter("cell <> o_cell").groupBy("root").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    com = _links(spark, d).select("event_id", "cause_cell").join(m, "event_id")
    near = com.join(o.select("root", F.col("o_cell").alias("cause_cell")), ["root", "cause_cell"]).groupBy("root").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    dx, dy = F.col("mx") - F.col("ox"), F.col("my") - F.col("oy")
    size, bar = F.sqrt(dx**2 + dy**2), F.sqrt((F.col("cx") - F.col("ox")) ** 2 + (F.col("cy") - F.col("oy")) ** 2)
    way = o.join(others, "root").join(near, "root").withColumns({"size": size, "bar": bar, "dx": dx, "dy": dy})
    good = (F.col("size") > 0) & (F.col("size") >= 0.5 * F.col("bar"))
    return way.withColumns({"vx": F.when(good, F.col("dx") / F.col("size")).otherwise(0.0), "vy": F.when(good, F.col("dy") / F.col("size")).otherwise(0.0)})


@query(f"{_LINKED}, {_DIRECTION} SELECT root, round(vx, 6) + 0.0 AS vx, round(vy, 6) + 0.0 AS vy FROM dir")
def event_direction(spark, d):
    return _direction(spark, d, _placed(spark, d)).select("root", (F.round("vx", 6) + 0.0).alias("vx"), (F.round("vy", 6) + 0.0).alias("vy"))


@query(f"""{_LINKED}, {_DIRECTION}, far AS (SELECT d.root, max((c.x - ox) * vx + (c.y - oy) * vy) AS reach, arg_min(c.frame, (-round((c.x - ox) * vx + (c.y - oy) * vy, 6), c.frame)) AS frame FROM dir d JOIN com c ON c.root = d.root AND c.cell <> d.o_cell GROUP BY d.root)
SELECT d.root, round(CASE WHEN reach > 1e-9 AND frame > o_frame THEN reach / (frame - o_frame) ELSE 0 END, 6) AS speed FROM dir d JOIN far USING (root)""")
def event_speed(spark, d):
    m = _placed(spark, d)
    way = _direction(spark, d, m)
    com = m.filter("depth > 0").select("root", "cell", "x", "y", "frame").join(way, "root").filter("cell <> o_cell")
    reach = (F.col("x") - F.col("ox")) * F.col("vx") + (F.col("y") - F.col("oy")) * F.col("vy")
    far = com.groupBy("root", "o_frame").agg(F.max(reach).alias("reach"), F.min(F.struct((-F.round(reach, 6)).alias("k"), "frame")).alias("b"))
    speed = F.when((F.col("reach") > 1e-9) & (F.col("b.frame") > F.col("o_frame")), F.col("reach") / (F.col("b.frame") - F.col("o_frame"))).otherwise(0.0)
    return far.select("root", F.round(speed, 6).alias("speed"))


@query(f"""{_LINKED}, m AS (SELECT root, count(*) AS n, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy FROM cells_of GROUP BY root), e AS (SELECT root, n, (xx + yy) / 2 AS h, sqrt(((xx - yy) / 2) ** 2 + xy ** 2) AS g FROM m)
SELECT root, CASE WHEN n < 3 THEN 1 WHEN h - g <= 1e-9 * h THEN NULL ELSE round(least(sqrt((h + g) / (h - g)), 100), 6) END AS elongation FROM e""")
def elongation(spark, d):
    """Ratio of the axes of an event's cells, from the eigenvalues of their covariance; null for cells on one line."""
    e = _cells_of(_placed(spark, d)).groupBy("root").agg(F.count("*").alias("n"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"))
    h, g = (F.col("xx") + F.col("yy")) / 2, F.sqrt(((F.col("xx") - F.col("yy")) / 2) ** 2 + F.col("xy") ** 2)
    return e.select("root", F.when(F.col("n") < 3, 1.0).when(h - g > 1e-9 * h, F.round(F.least(F.sqrt((h + g) / (h - g)), F.lit(100.0)), 6)).alias("elongation"))


@query(f"""{_LINKED}, m AS (SELECT root, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM cells_of GROUP BY root), r AS (SELECT root, max(sqrt((x - mx) ** 2 + (y - my) ** 2)) AS r FROM cells_of JOIN m USING (root) GROUP BY root)
SELECT root, round(CASE WHEN n < 3 OR r = 0 THEN 0 ELSE 1 - sqrt((ox - mx) ** 2 + (oy - my) ** 2) / r END, 6) + 0.0 AS radiality FROM m JOIN r USING (root) JOIN origin USING (root)""")
def radiality(spark, d):
    m = _placed(spark, d)
    c = _cells_of(m)
    mean = c.groupBy("root").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    far = c.join(mean, "root").groupBy("root", "n", "mx", "my").agg(F.max(F.sqrt((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2)).alias("r"))
    off = F.sqrt((F.col("ox") - F.col("mx")) ** 2 + (F.col("oy") - F.col("my")) ** 2)
    return far.join(_origin(m), "root").select("root", (F.round(F.when((F.col("n") < 3) | (F.col("r") == 0), 0.0).otherwise(1 - off / F.col("r")), 6) + 0.0).alias("radiality"))


@query(f"""{_LINKED}, p AS (SELECT DISTINCT 10.0 * (cell % 15) AS x, 10.0 * (cell // 15) AS y, cell FROM peaks), pop AS (SELECT avg(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS v FROM p a JOIN p b ON a.cell < b.cell),
own AS (SELECT a.root, avg(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS v FROM cells_of a JOIN cells_of b ON a.root = b.root AND a.cell < b.cell GROUP BY a.root) SELECT root, round(own.v / pop.v, 6) AS compactness FROM own, pop""")
def compactness(spark, d):
    m = _placed(spark, d)
    places = m.groupBy("root", "cell", "x", "y").agg(F.lit(1).alias("one"))
    a, b = places.select("root", F.col("cell").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay")), places.select("root", F.col("cell").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    own = a.join(b, "root").filter("a < b").groupBy("root").agg(F.avg(F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2)).alias("v"))
    cells = peaks(spark, d).select("cell").distinct().select((10.0 * (F.col("cell") % 15)).alias("x"), (10.0 * F.floor(F.col("cell") / 15)).alias("y"))
    population = stats.pair_distances(cells).select(F.col("mean_distance").alias("pop"))
    return own.crossJoin(F.broadcast(population)).select("root", F.round(F.col("v") / F.col("pop"), 6).alias("compactness"))


@query(f"""{_LINKED} SELECT p.cell, count(DISTINCT e.root) AS n_events, count(DISTINCT e.root) FILTER (e.depth = 0) AS n_as_origin, count(*) FILTER (e.root IS NULL) AS n_individual FROM peaks p LEFT JOIN ev e ON e.event_id = p.event_id GROUP BY p.cell""")
def occurrences(spark, d):
    m = _members(spark, d).select("event_id", "root", "depth")
    p = peaks(spark, d).select("event_id", "cell").join(m, "event_id", "left")
    return p.groupBy("cell").agg(F.countDistinct("root").alias("n_events"), F.countDistinct(F.when(F.col("depth") == 0, F.col("root"))).alias("n_as_origin"), F.count_if(F.col("root").isNull()).alias("n_individual"))


@query(f"{_LINKED}, big AS (SELECT root FROM cells_of GROUP BY root HAVING count(*) >= 3) SELECT s.cell, count(c.root) AS n_large FROM (SELECT DISTINCT cell FROM peaks) s LEFT JOIN cells_of c ON c.cell = s.cell AND c.root IN (SELECT root FROM big) GROUP BY s.cell")
def large_events(spark, d):
    c = _members(spark, d).select("root", "cell").distinct()
    big = c.groupBy("root").count().filter("count >= 3").select("root")
    n = c.join(big, "root", "left_semi").groupBy("cell").agg(F.count("*").alias("n"))
    return peaks(spark, d).select("cell").distinct().join(n, "cell", "left").select("cell", F.coalesce("n", F.lit(0)).alias("n_large"))


_FAST = """fast AS (SELECT c.cell, c.cause_cell, k.n > 2 AS big FROM (SELECT *, sqrt((cell % 15 - cause_cell % 15) ** 2 + (cell // 15 - cause_cell // 15) ** 2) / (frame - cause_frame) AS speed FROM com) c JOIN (SELECT root, count(*) AS n FROM cells_of GROUP BY root) k USING (root) WHERE speed > 0.2)"""


@query(f"""{_LINKED}, {_FAST}, s AS (SELECT cell, false AS origin, big FROM fast UNION ALL SELECT cause_cell, true, big FROM fast)
SELECT p.cell, count(s.cell) AS n_fast, count(*) FILTER (s.origin) AS n_fast_origin, count(*) FILTER (s.big) AS n_fast_big, count(*) FILTER (s.origin AND s.big) AS n_fast_big_origin FROM (SELECT DISTINCT cell FROM peaks) p LEFT JOIN s USING (cell) GROUP BY p.cell""")
def high_speed(spark, d):
    m = _members(spark, d)
    sizes = m.select("root", "cell").distinct().groupBy("root").agg((F.count("*") > 2).alias("big"))
    c, k = F.col("cell"), F.col("cause_cell")
    dist = F.sqrt(((c % 15 - k % 15) ** 2 + (F.floor(c / 15) - F.floor(k / 15)) ** 2).cast("double"))
    fast = _links(spark, d).filter(dist / F.col("lag") > 0.2).select("event_id", "cell", "cause_cell").join(m.select("event_id", "root"), "event_id").join(sizes, "root")
    sides = fast.select(F.explode(F.array(F.struct("cell", F.lit(False).alias("origin"), "big"), F.struct(k.alias("cell"), F.lit(True).alias("origin"), "big"))).alias("s")).select("s.*")
    n = sides.groupBy("cell").agg(F.count("*").alias("n_fast"), F.count_if("origin").alias("n_fast_origin"), F.count_if("big").alias("n_fast_big"), F.count_if(F.col("origin") & F.col("big")).alias("n_fast_big_origin"))
    return peaks(spark, d).select("cell").distinct().join(n, "cell", "left").na.fill(0)


_CELL = f"""{_PEAKS}, g AS (SELECT *, frame - lag(frame) OVER (PARTITION BY cell ORDER BY frame, event_id) AS gap FROM peaks)"""


@query(f"""WITH {_CELL}, m AS (SELECT cell, count(*) AS n, avg(height) AS m1, stddev_pop(height) AS s1, sum(height) AS a, sum(height ** 2) AS b, sum(height ** 3) AS c, avg(dur) AS md, stddev_pop(dur) AS sd, avg(gap) AS mg, stddev_pop(gap) AS sg, count(gap) AS ng FROM g GROUP BY cell)
SELECT cell, n, round(m1, 6) AS mean_height, round(s1, 6) AS std_height, round(s1 / nullif(m1, 0), 6) AS cv_height, round(CASE WHEN n > 2 THEN (c / n - 3 * m1 * b / n + 2 * m1 ** 3) / nullif(s1 ** 3, 0) END, 4) AS skew_height,
round(md, 6) AS mean_duration, round(sd, 6) AS std_duration, round(sd / nullif(md, 0), 6) AS cv_duration, round(mg, 6) AS mean_gap, round(sg, 6) AS std_gap, CASE WHEN ng > 1 THEN round(1 / (1 + sg / nullif(mg, 0)), 6) END AS periodicity FROM m""")
def cell_distributions(spark, d):
    w = Window.partitionBy("cell").orderBy("frame", "event_id")
    g = peaks(spark, d).withColumn("gap", F.col("frame") - F.lag("frame").over(w))
    cv = lambda c: F.round(F.stddev_pop(c) / F.nullif(F.avg(c), F.lit(0.0)), 6)
    r = lambda c, name: F.round(c, 6).alias(name)
    return g.groupBy("cell").agg(
        F.count("*").alias("n"), r(F.avg("height"), "mean_height"), r(F.stddev_pop("height"), "std_height"), cv("height").alias("cv_height"), F.when(F.count("*") > 2, F.round(F.skewness("height"), 4)).alias("skew_height"),
        r(F.avg("dur"), "mean_duration"), r(F.stddev_pop("dur"), "std_duration"), cv("dur").alias("cv_duration"), r(F.avg("gap"), "mean_gap"), r(F.stddev_pop("gap"), "std_gap"),
        F.when(F.count("gap") > 1, F.round(1 / (1 + F.stddev_pop("gap") / F.nullif(F.avg("gap"), F.lit(0.0))), 6)).alias("periodicity"),
    )


@query(f"""WITH {_CELL}, e AS (SELECT cell, min(gap) AS lo, max(gap) AS hi, count(gap) AS n FROM g GROUP BY cell), b AS (SELECT g.cell, n, CASE WHEN hi = lo THEN 5 ELSE least(floor((gap - lo) / ((hi - lo) / 10.0)), 9) END AS bin, count(*) AS c FROM g JOIN e USING (cell) WHERE gap IS NOT NULL GROUP BY ALL)
SELECT cell, CASE WHEN n > 1 THEN round(sum(-(c / n) * ln(c / n)), 6) + 0.0 END AS entropy FROM b GROUP BY cell, n""")
def gap_entropy(spark, d):
    w = Window.partitionBy("cell").orderBy("frame", "event_id")
    g = peaks(spark, d).withColumn("gap", F.col("frame") - F.lag("frame").over(w))
    return binning.entropy(g, ["cell"], "gap").select("cell", (F.round("entropy", 6) + 0.0).alias("entropy"))


@query(f"""WITH {_PEAKS}, e AS (SELECT cell, min(height) AS lo, max(height) AS hi FROM peaks GROUP BY cell), b AS (SELECT cell, least(floor((height - lo) / ((hi - lo) / 20)), 19) AS bin, count(*) AS n FROM peaks JOIN e USING (cell) GROUP BY ALL)
SELECT cell, CAST(bin AS BIGINT) AS bin, n FROM b""")
def height_histograms(spark, d):
    p = peaks(spark, d)
    e = p.groupBy("cell").agg(F.min("height").alias("lo"), F.max("height").alias("hi"))
    at = F.least(F.floor((F.col("height") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 20)), F.lit(19))
    return p.join(e, "cell").groupBy("cell", at.alias("bin")).agg(F.count("*").alias("n"))


@query(f"""WITH {_PEAKS}, c AS (SELECT dataset, cell, count(*) AS n FROM peaks GROUP BY ALL), a AS (SELECT count(DISTINCT cell) AS total FROM peaks)
SELECT dataset, count(*) AS n_active, round(count(*) / any_value(total), 6) AS active_share, round(avg(n), 6) AS mean_peaks, round(stddev_pop(n) / avg(n), 6) AS cv_peaks FROM c, a GROUP BY dataset""")
def population_metrics(spark, d):
    p = peaks(spark, d)
    c = p.groupBy("dataset", "cell").agg(F.count("*").alias("n"))
    total = p.agg(F.countDistinct("cell").alias("total"))
    out = c.groupBy("dataset").agg(F.count("*").alias("n_active"), F.avg("n").alias("m"), F.stddev_pop("n").alias("s")).crossJoin(F.broadcast(total))
    return out.select("dataset", "n_active", F.round(F.col("n_active") / F.col("total"), 6).alias("active_share"), F.round("m", 6).alias("mean_peaks"), F.round(F.col("s") / F.col("m"), 6).alias("cv_peaks"))


@query(f"""{_LINKED}, k AS (SELECT root, count(*) AS v FROM cells_of GROUP BY root), s AS (SELECT root, max(frame) - min(frame) AS v FROM ev GROUP BY root), l AS (SELECT frame - cause_frame AS v FROM com),
u AS (SELECT 'cells' AS metric, v FROM k UNION ALL SELECT 'duration', v FROM s UNION ALL SELECT 'lag', v FROM l) SELECT metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, CAST(min(v) AS DOUBLE) AS lo, CAST(max(v) AS DOUBLE) AS hi, count(*) AS n FROM u GROUP BY metric""")
def event_distributions(spark, d):
    m = _members(spark, d)
    per = m.groupBy("root").agg(F.countDistinct("cell").cast("double").alias("cells"), (F.max("frame") - F.min("frame")).cast("double").alias("duration")).unpivot([], ["cells", "duration"], "metric", "value")
    lags = _links(spark, d).select(F.lit("lag").alias("metric"), F.col("lag").cast("double").alias("value"))
    return binning.distribution(per.unionByName(lags), ["metric"], "value")


_BINS = f"""{_GLOBAL}, spans AS (SELECT event, min(frame) AS a, max(frame) AS b FROM globals GROUP BY event), bins AS (SELECT event, i, a + i * (b - a + 1) // 6 AS lo, CASE WHEN i = 5 THEN b ELSE a + (i + 1) * (b - a + 1) // 6 - 1 END AS hi FROM spans, (SELECT unnest(range(0, 6)) AS i)),
held AS (SELECT DISTINCT k.event, k.i, g.cell, 10.0 * (g.cell % 15) AS x, 10.0 * (g.cell // 15) AS y FROM bins k JOIN globals g ON g.event = k.event AND g.frame BETWEEN k.lo AND k.hi),
mid AS (SELECT event, i, median(x) AS mx, median(y) AS my FROM held GROUP BY ALL), off AS (SELECT h.*, sqrt((x - mx) ** 2 + (y - my) ** 2) AS r FROM held h JOIN mid USING (event, i)), md AS (SELECT event, i, median(r) AS m FROM off GROUP BY ALL),
bar AS (SELECT o.event, o.i, any_value(m) + 3 * median(abs(r - m)) AS bar FROM off o JOIN md USING (event, i) GROUP BY ALL), com AS (SELECT o.event, o.i, avg(x) AS x, avg(y) AS y FROM off o JOIN bar USING (event, i) WHERE r <= bar + 1e-9 GROUP BY ALL),
points AS (SELECT k.event, k.i, (k.lo + k.hi) / 2.0 AS t, k.hi >= k.lo AS has, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM bins k LEFT JOIN com USING (event, i)), inner_points AS (SELECT * FROM points WHERE i BETWEEN 1 AND 4),
way AS (SELECT event, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, max(x) FILTER (i = 4) - max(x) FILTER (i = 1) AS dx, max(y) FILTER (i = 4) - max(y) FILTER (i = 1) AS dy, max(t) FILTER (i = 4 AND has) - max(t) FILTER (i = 1 AND has) AS dt FROM inner_points GROUP BY event),
wide AS (SELECT a.event, max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS extent FROM held a JOIN held b ON a.event = b.event GROUP BY a.event)"""


def wave_bins(g: DataFrame, bins: int = 6, spread: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """Cells of each time bin of each event (event, i, x, y), and each bin's middle (event, i, t, some, x, y).

    A middle is the mean of the cells no further from the median place than the median distance plus ``spread`` median deviations; (0, 0) for an empty bin.
    """
    span = g.groupBy("event").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    edge = lambda i: F.col("a") + F.floor(i * (F.col("b") - F.col("a") + 1) / bins)
    grid = span.withColumn("i", F.explode(F.array(*map(F.lit, range(bins))))).withColumns({"lo": edge(F.col("i")), "hi": F.when(F.col("i") == bins - 1, F.col("b")).otherwise(edge(F.col("i") + 1) - 1)})
    grid = graph.cut(grid.select("event", "i", "lo", "hi"))
    held = g.join(F.broadcast(grid), "event").filter(F.col("frame").between(F.col("lo"), F.col("hi"))).select("event", "i", "cell").distinct()
    held = graph.cut(held.select("event", "i", (10.0 * (F.col("cell") % 15)).alias("x"), (10.0 * F.floor(F.col("cell") / 15)).alias("y")))
    # Bins of one event hold at most the cells of a recording.
    middle = held.groupBy("event", "i").agg(F.median("x").alias("mx"), F.median("y").alias("my"))
    off = held.join(middle, ["event", "i"]).withColumn("r", F.sqrt((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2))
    near = off.groupBy("event", "i").agg(F.median("r").alias("m"))
    away = off.join(near, ["event", "i"]).groupBy("event", "i").agg((F.first("m") + spread * F.median(F.abs(F.col("r") - F.col("m")))).alias("bar"))
    com = off.join(away, ["event", "i"]).filter(F.col("r") <= F.col("bar") + 1e-9).groupBy("event", "i").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    points = grid.join(com, ["event", "i"], "left")
    return held, points.select("event", "i", ((F.col("lo") + F.col("hi")) / 2).alias("t"), (F.col("hi") >= F.col("lo")).alias("some"), F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))


@query(f"""WITH {_BINS} SELECT event, round(sqrt(dx * dx + dy * dy), 6) AS net, round(extent, 6) AS extent, extent > 0 AND sqrt(dx * dx + dy * dy) >= 0.25 * extent AS is_directional,
round(CASE WHEN extent > 0 AND sqrt(dx * dx + dy * dy) >= 0.25 * extent THEN abs(cos(0.5 * atan2(2 * xy, xx - yy))) ELSE 0 END, 4) AS along_x,
round(CASE WHEN extent > 0 AND sqrt(dx * dx + dy * dy) >= 0.25 * extent AND dt > 0 THEN sqrt(dx * dx + dy * dy) / dt ELSE 0 END, 6) AS speed FROM way JOIN wide USING (event)""")
def global_direction(spark, d):
    """Main axis of the middles of the inner time bins, if the wave moved by a quarter of its extent, and its speed from the first of them to the last."""
    held, points = wave_bins(_globals(spark, d))
    at = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
    timed = lambda i: F.max(F.when((F.col("i") == i) & F.col("some"), F.col("t")))
    way = points.filter("i BETWEEN 1 AND 4").groupBy("event").agg(
        F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"), (at("x", 4) - at("x", 1)).alias("dx"), (at("y", 4) - at("y", 1)).alias("dy"), (timed(4) - timed(1)).alias("dt")
    )
    # The farthest pair are corners of the hull, so only the two ends of each grid column are paired: at most 30 places an event.
    ends = held.groupBy("event", "x").agg(F.array_distinct(F.array(F.min("y"), F.max("y"))).alias("y"))
    a = graph.cut(ends.select("event", "x", F.explode("y").alias("y")))
    b = a.toDF("event", "bx", "by")
    wide = a.join(b, "event").groupBy("event").agg(F.max(F.sqrt((F.col("x") - F.col("bx")) ** 2 + (F.col("y") - F.col("by")) ** 2)).alias("extent"))
    net = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)
    moved = (F.col("extent") > 0) & (net >= 0.25 * F.col("extent"))
    axis = F.abs(F.cos(0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy"))))
    speed = F.when(moved & (F.col("dt") > 0), net / F.col("dt")).otherwise(0.0)
    return way.join(wide, "event").select("event", F.round(net, 6).alias("net"), F.round("extent", 6).alias("extent"), moved.alias("is_directional"), F.round(F.when(moved, axis).otherwise(0.0), 4).alias("along_x"), F.round(speed, 6).alias("speed"))
