"""Queries over dense traces: cuts, baselines, scaling, smoothing, detrending, peak detection and binary activity, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions import detrend, signals
from tidewave.plans.catalog import _PEAKS, query, rows_only
from tidewave.sources.tables import peaks

_TRACE = f"""{_PEAKS}, len AS (SELECT max(frame) + 1 AS len FROM peaks), v AS (SELECT cell, frame, sum(height) AS v FROM peaks WHERE frame >= 0 GROUP BY ALL),
trace AS (SELECT c.cell, f.frame, coalesce(v.v, 0) AS v FROM (SELECT DISTINCT cell FROM v) c CROSS JOIN (SELECT unnest(range(0, (SELECT len FROM len))) AS frame) f LEFT JOIN v ON v.cell = c.cell AND v.frame = f.frame)"""
_MIRROR = "CASE WHEN i < 0 THEN -i - 1 WHEN i >= len THEN 2 * len - 1 - i ELSE i END"


def _traces(spark, d) -> DataFrame:
    return signals.dense(peaks(spark, d), ["cell"], "frame", "height")


def _long(traces: DataFrame, name: str, digits: int = 6) -> DataFrame:
    return traces.select("cell", F.posexplode("values").alias("frame", name)).select("cell", F.col("frame").cast("long").alias("frame"), F.round(name, digits).alias(name))


def _samples(spark, d) -> DataFrame:
    return _traces(spark, d).select("cell", F.posexplode("values").alias("frame", "v")).withColumn("frame", F.col("frame").cast("long"))


def weighted(traces: DataFrame, weights: list[float], name: str) -> DataFrame:
    """A weighted mean around each sample by one kernel a trace; beyond the ends the trace is mirrored."""
    kernel = np.array(weights, float)
    return signals.transform(traces, ["cell"], lambda x: signals.convolve(x, kernel), name)


@query(f"WITH {_TRACE} SELECT cell, CAST(frame AS BIGINT) AS frame, round(v, 6) AS value FROM trace")
def dense_traces(spark, d):
    return _long(_traces(spark, d), "value")


@query(f"WITH {_TRACE} SELECT cell, CAST(frame - 100 AS BIGINT) AS frame, round(v, 6) AS value FROM trace WHERE frame >= 100")
def cut_trace(spark, d):
    # Longer than the cut or empty: a slice of an array has no negative size.
    n = F.greatest(F.size("values") - 100, F.lit(0))
    return _long(_traces(spark, d).select("cell", F.slice("values", F.lit(101), n).alias("values")), "value")


@query(f"""WITH {_TRACE}, n AS (SELECT cell, frame, unnest(range(frame - 5, frame + 6)) AS i FROM trace), m AS (SELECT cell, frame, {_MIRROR} AS i FROM n, len)
SELECT m.cell, CAST(m.frame AS BIGINT) AS frame, round(avg(t.v), 6) AS baseline FROM m JOIN trace t ON t.cell = m.cell AND t.frame = m.i GROUP BY ALL""")
def moving_average_baseline(spark, d):
    return _long(weighted(_traces(spark, d), [1 / 11] * 11, "values"), "baseline")


@query(f"""WITH {_TRACE}, k AS (SELECT j, exp(-0.5 * (j / 1.5) ** 2) AS w FROM (SELECT unnest(range(-6, 7)) AS j)), n AS (SELECT cell, frame, frame + j AS i, w FROM trace, k), m AS (SELECT cell, frame, {_MIRROR} AS i, w FROM n, len)
SELECT m.cell, CAST(m.frame AS BIGINT) AS frame, round(sum(t.v * w) / sum(w), 6) AS smooth FROM m JOIN trace t ON t.cell = m.cell AND t.frame = m.i GROUP BY ALL""")
def gaussian(spark, d):
    import math

    w = [math.exp(-0.5 * (j / 1.5) ** 2) for j in range(-6, 7)]
    return _long(weighted(_traces(spark, d), [x / sum(w) for x in w], "values"), "smooth")


@query(f"WITH {_TRACE}, f AS (SELECT cell, regr_slope(v, frame) AS a, regr_intercept(v, frame) AS b FROM trace GROUP BY cell) SELECT cell, CAST(frame AS BIGINT) AS frame, round(v - (a * frame + b), 6) AS rest FROM trace JOIN f USING (cell)")
def linear_baseline(spark, d):
    s = _samples(spark, d)
    fit = s.groupBy("cell").agg(F.regr_slope("v", "frame").alias("a"), F.regr_intercept("v", "frame").alias("b"))
    return s.join(fit, "cell").select("cell", "frame", F.round(F.col("v") - (F.col("a") * F.col("frame") + F.col("b")), 6).alias("rest"))


@query(f"WITH {_TRACE} SELECT cell, CAST(frame AS BIGINT) AS frame, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w + 1e-8), 6) AS scaled FROM trace WINDOW w AS (PARTITION BY cell)")
def minmax_traces(spark, d):
    # The ends of a trace are found once, below the explosion; inside a lambda or beside it they would be sought for every sample.
    lo, span = F.array_min("values").alias("lo"), (F.array_max("values") - F.array_min("values") + signals.EPS).alias("span")
    s = _traces(spark, d).select("cell", "values", lo, span).select("cell", "lo", "span", F.posexplode("values").alias("frame", "v"))
    return s.select("cell", F.col("frame").cast("long").alias("frame"), F.round((F.col("v") - F.col("lo")) / F.col("span"), 6).alias("scaled"))


@query(f"WITH {_TRACE}, q AS (SELECT cell, quantile_cont(v, 0.9) AS base, max(v) AS hi FROM trace GROUP BY cell) SELECT cell, CAST(frame AS BIGINT) AS frame, round((v - base) / (hi - base + 1e-8), 6) AS scaled FROM trace JOIN q USING (cell)")
def pct_norm(spark, d):
    return _long(signals.transform(_traces(spark, d), ["cell"], lambda x: signals.percentile_scale(x, 90)), "scaled")


@query(f"""WITH {_TRACE}, q AS (SELECT cell, greatest(quantile_cont(v, 0.9), 0.5) AS base FROM trace GROUP BY cell), x AS (SELECT cell, frame, (v - base) / (base + 1e-8) AS x FROM trace JOIN q USING (cell))
SELECT cell, CAST(frame AS BIGINT) AS frame, round(x / (max(abs(x)) OVER (PARTITION BY cell) + 1e-8), 6) AS scaled FROM x""")
def deltaf(spark, d):
    return _long(signals.transform(_traces(spark, d), ["cell"], lambda x: signals.delta_f(x, 90, 0.5)), "scaled")


@query(f"""WITH {_TRACE}, k AS (SELECT j, exp(-0.5 * (j / 2.0) ** 2) AS w FROM (SELECT unnest(range(-8, 9)) AS j)), n AS (SELECT cell, frame, frame + j AS i, w FROM trace, k), m AS (SELECT cell, frame, {_MIRROR} AS i, w FROM n, len),
s AS (SELECT m.cell, m.frame, sum(t.v * w) / sum(w) AS s FROM m JOIN trace t ON t.cell = m.cell AND t.frame = m.i GROUP BY ALL), r AS (SELECT cell, frame, v, v - s AS r FROM s JOIN trace USING (cell, frame)),
b AS (SELECT cell, quantile_cont(abs(r), 0.8) AS bar FROM r GROUP BY cell), o AS (SELECT cell, stddev_pop(r) FILTER (abs(r) < bar) AS sd FROM r JOIN b USING (cell) GROUP BY cell)
SELECT cell, CAST(frame AS BIGINT) AS frame, round(v / (sd + 1e-8), 5) AS z FROM r JOIN o USING (cell)""")
def zscore_noise(spark, d):
    return _long(signals.transform(_traces(spark, d), ["cell"], lambda x: signals.noise_score(x, 2.0)), "z", 5)


@query(f"WITH {_TRACE} SELECT CAST(frame AS BIGINT) AS frame, round(avg(v), 6) AS mean_value FROM trace GROUP BY frame")
def global_trace(spark, d):
    return _samples(spark, d).groupBy("frame").agg(F.round(F.avg("v"), 6).alias("mean_value"))


_VERSIONS = f"""{_TRACE}, versions AS (SELECT cell, frame, 'raw' AS version, v FROM trace UNION ALL SELECT cell, frame, 'centred', v - avg(v) OVER (PARTITION BY cell) FROM trace UNION ALL SELECT cell, frame, 'steps', coalesce(v - lag(v) OVER (PARTITION BY cell ORDER BY frame), 0) FROM trace)"""


@query(f"WITH {_VERSIONS} SELECT version, cell, round(min(v), 6) AS lo, round(max(v), 6) AS hi, count(*) AS n FROM versions GROUP BY ALL")
def trace_versions(spark, d):
    """Each stage of a trace is kept under its name, one row a version."""
    t = _traces(spark, d)
    mean = F.aggregate("values", F.lit(0.0), lambda s, v: s + v) / F.size("values")
    steps = F.zip_with("values", F.concat(F.slice("values", 1, 1), F.slice("values", 1, F.greatest(F.size("values") - 1, F.lit(0)))), lambda a, b: a - b)
    kinds = {"raw": F.col("values"), "centred": F.transform("values", lambda v: v - mean), "steps": steps}
    long = t.select("cell", F.explode(F.array(*[F.struct(F.lit(k).alias("version"), v.alias("values")) for k, v in kinds.items()])).alias("s")).select("cell", "s.*")
    return long.select("version", "cell", F.round(F.array_min("values"), 6).alias("lo"), F.round(F.array_max("values"), 6).alias("hi"), F.size("values").cast("long").alias("n"))


_GAUSS = f"""{_TRACE}, sk AS (SELECT j, exp(-0.5 * (j / 2.0) ** 2) AS w FROM (SELECT unnest(range(-8, 9)) AS j)), sn AS (SELECT cell, frame, frame + j AS i, w FROM trace, sk), sm AS (SELECT cell, frame, {_MIRROR} AS i, w FROM sn, len),
smooth AS (SELECT m.cell, m.frame, round(sum(t.v * w) / sum(w), 6) AS v FROM sm m JOIN trace t ON t.cell = m.cell AND t.frame = m.i GROUP BY ALL)"""


def _smooth(spark, d) -> DataFrame:
    """Smoothed traces, rounded so that equal samples are equal in every engine."""
    import math

    w = [math.exp(-0.5 * (j / 2.0) ** 2) for j in range(-8, 9)]
    return weighted(_traces(spark, d), [x / sum(w) for x in w], "values").select("cell", F.transform("values", lambda v: F.round(v, 6)).alias("values"))


def _smooth_samples(spark, d) -> DataFrame:
    return _smooth(spark, d).select("cell", F.posexplode("values").alias("frame", "v")).withColumn("frame", F.col("frame").cast("long"))


@query(f"""WITH {_GAUSS}, x AS (SELECT *, min(v) OVER (PARTITION BY cell ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS a, min(v) OVER (PARTITION BY cell ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS b FROM smooth)
SELECT cell, CAST(frame AS BIGINT) AS frame FROM x WHERE v < a AND v < b""")
def local_minima(spark, d):
    w = Window.partitionBy("cell").orderBy("frame")
    x = _smooth_samples(spark, d).withColumns({"a": F.min("v").over(w.rowsBetween(-5, -1)), "b": F.min("v").over(w.rowsBetween(1, 5))})
    return x.filter("v < a AND v < b").select("cell", "frame")


@query(f"""WITH {_GAUSS}, x AS (SELECT *, min(v) OVER (PARTITION BY cell ORDER BY frame ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS a, min(v) OVER (PARTITION BY cell ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS b FROM smooth),
k AS (SELECT cell, frame, v, CASE WHEN v < a AND v < b THEN frame END AS f, CASE WHEN v < a AND v < b THEN v END AS u FROM x),
p AS (SELECT *, last_value(f IGNORE NULLS) OVER w1 AS f0, last_value(u IGNORE NULLS) OVER w1 AS u0, first_value(f IGNORE NULLS) OVER w2 AS f1, first_value(u IGNORE NULLS) OVER w2 AS u1 FROM k
  WINDOW w1 AS (PARTITION BY cell ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), w2 AS (PARTITION BY cell ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT cell, CAST(frame AS BIGINT) AS frame, round(greatest(v - CASE WHEN f0 IS NULL THEN u1 WHEN f1 IS NULL OR f0 = f1 THEN u0 ELSE u0 + (u1 - u0) * (frame - f0) / (f1 - f0) END, 0) + 1e-9, 5) AS above FROM p WHERE f0 IS NOT NULL OR f1 IS NOT NULL""")
def minima_lines(spark, d):
    """Straight lines through the minima, flat outside; what lies above them."""
    w = Window.partitionBy("cell").orderBy("frame")
    x = _smooth_samples(spark, d).withColumns({"a": F.min("v").over(w.rowsBetween(-5, -1)), "b": F.min("v").over(w.rowsBetween(1, 5))})
    low = (F.col("v") < F.col("a")) & (F.col("v") < F.col("b"))
    k = x.withColumn("s", F.when(low, F.struct("frame", "v")))
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    p = k.withColumns({"p": F.last("s", True).over(back), "q": F.first("s", True).over(ahead)}).filter("p IS NOT NULL OR q IS NOT NULL")
    line = F.when(F.col("p").isNull(), F.col("q.v")).when(F.col("q").isNull() | (F.col("p.frame") == F.col("q.frame")), F.col("p.v"))
    line = line.otherwise(F.col("p.v") + (F.col("q.v") - F.col("p.v")) * (F.col("frame") - F.col("p.frame")) / (F.col("q.frame") - F.col("p.frame")))
    return p.select("cell", "frame", F.round(F.greatest(F.col("v") - line, F.lit(0.0)) + 1e-9, 5).alias("above"))


_TOPS = f"""{_GAUSS}, runs AS (SELECT cell, any_value(v) AS v, min(frame) AS a, max(frame) AS b FROM (SELECT *, sum(new) OVER (PARTITION BY cell ORDER BY frame) AS run FROM (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY cell ORDER BY frame) THEN 0 ELSE 1 END AS new FROM smooth)) GROUP BY cell, run),
tops AS (SELECT cell, (a + b) // 2 AS frame, v FROM (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS r FROM runs WINDOW w AS (PARTITION BY cell ORDER BY a)) WHERE v > l AND v > r)"""


@query(f"""WITH {_TOPS}, e AS (SELECT t.cell, t.frame, t.v, coalesce(max(s.frame) FILTER (s.frame < t.frame), -1) AS lo, coalesce(min(s.frame) FILTER (s.frame > t.frame), (SELECT len FROM len)) AS hi FROM tops t LEFT JOIN smooth s ON s.cell = t.cell AND s.v > t.v GROUP BY ALL)
SELECT e.cell, CAST(e.frame AS BIGINT) AS frame, round(any_value(e.v) - greatest(min(s.v) FILTER (s.frame <= e.frame), min(s.v) FILTER (s.frame >= e.frame)), 6) AS prominence FROM e JOIN smooth s ON s.cell = e.cell AND s.frame > lo AND s.frame < hi GROUP BY e.cell, e.frame""")
def prominence(spark, d):
    found = signals.detect(_smooth(spark, d), ["cell"], 0.0)
    return found.select("cell", F.col("frame").cast("long").alias("frame"), F.round("prominence", 6).alias("prominence"))


@query(f"""WITH {_TOPS}, low AS (SELECT cell, frame FROM (SELECT *, min(v) OVER (PARTITION BY cell ORDER BY frame ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS m FROM smooth) WHERE v <= m)
SELECT t.cell, CAST(t.frame AS BIGINT) AS frame, CAST(coalesce(max(l.frame) FILTER (l.frame < t.frame), greatest(t.frame - 350, 0)) AS BIGINT) AS left_end, CAST(coalesce(min(l.frame) FILTER (l.frame > t.frame), least(t.frame + 350, (SELECT len - 1 FROM len))) AS BIGINT) AS right_end
FROM tops t LEFT JOIN low l ON l.cell = t.cell AND l.frame BETWEEN t.frame - 350 AND t.frame + 350 GROUP BY t.cell, t.frame""")
def valley_bounds(spark, d):
    def ends(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for cell, values in zip(pdf["cell"], pdf["values"]):
                x = np.asarray(values, float)
                out += [(cell, int(p), *signals.valleys(x, int(p))) for p in signals.maxima(x)]
            yield pd.DataFrame(out, columns=["cell", "frame", "left_end", "right_end"])

    return _smooth(spark, d).mapInPandas(ends, "cell long, frame long, left_end long, right_end long")


_SPANS = f"{_PEAKS}, spans AS (SELECT event_id, cell, frame AS t, frame - dur // 2 AS a, frame + dur AS b, height FROM peaks)"


@query(f"""WITH {_SPANS}, kids AS (SELECT DISTINCT c.event_id FROM spans c JOIN spans p ON p.cell = c.cell AND p.event_id <> c.event_id AND (p.height > c.height OR (p.height = c.height AND (p.t, p.event_id) < (c.t, c.event_id))) AND least(c.b, p.b) - greatest(c.a, p.a) + 1 >= 2)
SELECT event_id, cell, CAST(row_number() OVER (PARTITION BY cell ORDER BY t, event_id) - 1 AS BIGINT) AS peak_number FROM spans WHERE event_id NOT IN (SELECT event_id FROM kids)""")
def peak_renumber(spark, d):
    """Peaks that a taller one of their cell overlaps go; the rest are numbered from 0 in the order of time."""
    from tidewave.operators import joins

    p = peaks(spark, d).select("event_id", "cell", F.col("frame").alias("t"), (F.col("frame") - F.floor(F.col("dur") / 2)).alias("a"), (F.col("frame") + F.col("dur")).alias("b"), "height")
    other = p.select("cell", *[F.col(c).alias(f"o_{c}") for c in ("event_id", "t", "a", "b", "height")])
    # Of two overlapping spans one starts inside the other.
    met = joins.range_join(p, other, ["cell"], "a", "b", "o_a", 16).filter((F.col("event_id") != F.col("o_event_id")) & (F.least("b", "o_b") - F.greatest("a", "o_a") + 1 >= 2))
    mine, theirs = F.struct((-F.col("height")).alias("h"), F.col("t").alias("t"), F.col("event_id").alias("e")), F.struct((-F.col("o_height")).alias("h"), F.col("o_t").alias("t"), F.col("o_event_id").alias("e"))
    lower = met.select(F.when(mine > theirs, F.col("event_id")).otherwise(F.col("o_event_id")).alias("event_id")).distinct()
    number = F.row_number().over(Window.partitionBy("cell").orderBy("t", "event_id")) - 1
    return p.join(lower, "event_id", "left_anti").select("event_id", "cell", number.cast("long").alias("peak_number"))


@query(f"WITH {_SPANS} SELECT event_id, CASE WHEN b > a THEN round(1 - abs((t - a) - (b - t)) / CAST(b - a AS DOUBLE), 6) END AS symmetry FROM spans")
def symmetry(spark, d):
    rise, decay = F.floor(F.col("dur") / 2), F.col("dur")
    return peaks(spark, d).select("event_id", F.when(rise + decay > 0, F.round(1 - F.abs(rise - decay) / (rise + decay), 6)).alias("symmetry"))


@query("SELECT c_custkey, c_custkey IN (SELECT user_id FROM events) AS is_active FROM customer")
def active_cells(spark, d):
    from tidewave.operators import joins
    from tidewave.sources.tables import table

    return joins.mark_join(table(spark, d, "customer").select("c_custkey"), peaks(spark, d).select(F.col("cell").alias("c_custkey")), "c_custkey", "is_active")


@query(f"WITH {_PEAKS} SELECT cell, frame, min(event_id) AS event_id FROM peaks GROUP BY ALL")
def peak_starting_at(spark, d):
    """The first peak of each cell at each frame: what a look-up of (cell, frame) gives."""
    return peaks(spark, d).groupBy("cell", "frame").agg(F.min("event_id").alias("event_id"))


def _detected(spark, d):
    # Counts of events hold runs of zeros, which have no strict minima, so these traces are smoothed before they are detrended.
    figures = detrend.Minima(order=5)
    smooth = signals.transform(_traces(spark, d), ["cell"], lambda x: signals.gaussian(signals.noise_score(detrend.through_minima(signals.gaussian(x, 2.0), figures)), 2.0))
    return signals.detect(smooth, ["cell"], 0.5, 3, parents_only=True)


@rows_only
def detected_peaks(spark, d):
    return _detected(spark, d)


@rows_only
def binary_activity(spark, d):
    return signals.binary(_detected(spark, d), ["cell"], peaks(spark, d)).groupBy("frame").agg(F.count("*").alias("active_cells"))


@rows_only
def activity_trace_peaks(spark, d):
    """Peaks of the activity of all cells, with spans that shrink to the valleys around."""
    active = signals.binary(_detected(spark, d), ["cell"], peaks(spark, d)).groupBy("frame").agg(F.count("*").cast("double").alias("n"))
    one = signals.dense(active.withColumn("population", F.lit(0)), ["population"], "frame", "n")
    return signals.detect(one, ["population"], 1.0, 10, base_part=0.95, refine=True)


def _detrender(method: str):
    def run(spark, d):
        return _long(signals.transform(_traces(spark, d), ["cell"], detrend.METHODS[method]), "rest")

    run.__name__ = f"detrend_{method}"
    return rows_only(run)


DETRENDERS = {method: _detrender(method) for method in detrend.METHODS}
