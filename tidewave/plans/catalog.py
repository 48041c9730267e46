"""Named queries over the driver's tables, and independently written SQL for them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewave.functions import stats
from tidewave.operators import joins
from tidewave.sources.tables import last_frame, neighbours, peaks, table

QUERIES, ORACLE_SQL = {}, {}

_PEAKS = """peaks AS (SELECT event_id, user_id AS cell, event_type AS dataset,
  CAST(floor(epoch(ts - TIMESTAMP '2024-01-01') / 3600) AS BIGINT) AS frame, value AS height,
  CAST(floor(CAST(json_extract(props, '$.k') AS DOUBLE) / 10) AS BIGINT) AS dur FROM events)"""
_EDGES = """cells AS (SELECT DISTINCT cell FROM peaks),
edges AS (SELECT a.cell, b.cell AS neighbour FROM cells a JOIN cells b ON a.cell <> b.cell
  AND abs(a.cell % 15 - b.cell % 15) <= 1 AND abs(a.cell // 15 - b.cell // 15) <= 1)"""
_LINKS = """links AS (SELECT * FROM (SELECT p.event_id, p.cell, p.dataset, p.frame, q.event_id AS cause_id, q.cell AS cause_cell, p.frame - q.frame AS lag,
  row_number() OVER (PARTITION BY p.event_id ORDER BY q.frame, q.event_id) AS r
  FROM peaks p JOIN edges e ON p.cell = e.cell JOIN peaks q ON q.cell = e.neighbour AND q.dataset = p.dataset AND q.frame BETWEEN p.frame - 15 AND p.frame - 1) WHERE r = 1)"""
_WINDOWS = """active AS (SELECT DISTINCT dataset, cell, f FROM (SELECT dataset, cell, unnest(range(frame, frame + dur + 1)) AS f FROM peaks) WHERE f <= (SELECT max(frame) FROM peaks)),
trace AS (SELECT dataset, f AS frame, count(*) AS cells FROM active GROUP BY ALL),
high AS (SELECT dataset, frame, cells, frame - row_number() OVER (PARTITION BY dataset ORDER BY frame) AS run
  FROM (SELECT *, 0.6 * max(cells) OVER (PARTITION BY dataset) AS bar FROM trace) WHERE cells >= bar),
windows AS (SELECT dataset, min(frame) AS first_frame, max(frame) AS last_frame, max(cells) AS peak_cells FROM high GROUP BY dataset, run)"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rows_only(f):
    """A query without SQL."""
    QUERIES[f.__name__] = f
    return f


def _links(spark, d):
    return joins.farthest_back_on_grid(peaks(spark, d), 15)


def _trace(p):
    active = p.crossJoin(F.broadcast(last_frame(p)))
    return active.select("dataset", "cell", F.explode(F.sequence("frame", F.least(F.col("frame") + F.col("dur"), F.col("last")))).alias("frame")).groupBy("dataset", "frame").agg(F.countDistinct("cell").alias("cells"))


def _windows(p):
    bar = 0.6 * F.max("cells").over(Window.partitionBy("dataset"))
    high = _trace(p).withColumn("bar", bar).filter("cells >= bar")
    run = F.col("frame") - F.row_number().over(Window.partitionBy("dataset").orderBy("frame"))
    return high.withColumn("run", run).groupBy("dataset", "run").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.max("cells").alias("peak_cells")).drop("run")


@query(f"WITH {_PEAKS}, {_WINDOWS} SELECT * FROM windows")
def activity_windows(spark, d):
    return _windows(peaks(spark, d))


@query(f"WITH {_PEAKS}, {_WINDOWS} SELECT * FROM trace")
def activity_trace(spark, d):
    return _trace(peaks(spark, d))


@query(f"WITH {_PEAKS}, {_WINDOWS} SELECT w.dataset, first_frame, count(*) AS n_peaks, count(DISTINCT cell) AS n_cells FROM windows w JOIN peaks p ON p.dataset = w.dataset AND p.frame BETWEEN first_frame AND last_frame GROUP BY ALL")
def range_join_window(spark, d):
    p = peaks(spark, d)
    met = joins.range_join(_windows(p), p, ["dataset"], "first_frame", "last_frame", "frame", 24)
    return met.groupBy("dataset", "first_frame").agg(F.count("*").alias("n_peaks"), F.countDistinct("cell").alias("n_cells"))


@query(f"WITH {_PEAKS}, {_EDGES}, {_LINKS} SELECT event_id, cell, dataset, frame, cause_id, cause_cell, lag FROM links")
def farthest_back_link(spark, d):
    return _links(spark, d)


@query(f"WITH {_PEAKS}, {_EDGES}, {_LINKS}, a AS (SELECT cause_cell AS cell, count(*) AS n FROM links GROUP BY 1), b AS (SELECT cell, count(*) AS n FROM links GROUP BY 1) SELECT coalesce(a.cell, b.cell) AS cell, coalesce(a.n, 0) AS as_cause, coalesce(b.n, 0) AS as_target FROM a FULL JOIN b ON a.cell = b.cell")
def outer_counts(spark, d):
    links = _links(spark, d)
    sides = links.select(F.explode(F.array(F.struct(F.col("cause_cell").alias("cell"), F.lit(1).alias("c")), F.struct("cell", F.lit(0).alias("c")))).alias("s")).select("s.*")
    return sides.groupBy("cell").agg(F.sum("c").alias("as_cause"), F.sum(1 - F.col("c")).alias("as_target"))


@query(f"WITH {_PEAKS}, {_EDGES}, {_LINKS} SELECT e.cell AS cell_a, e.neighbour AS cell_b, count(event_id) AS n_links FROM edges e LEFT JOIN links l ON least(l.cell, l.cause_cell) = e.cell AND greatest(l.cell, l.cause_cell) = e.neighbour WHERE e.cell < e.neighbour GROUP BY 1, 2")
def neighbor_pair_stats(spark, d):
    p = peaks(spark, d)
    pairs = neighbours(p.select("cell").distinct()).filter("cell < neighbour").toDF("cell_a", "cell_b")
    n = _links(spark, d).groupBy(F.least("cell", "cause_cell").alias("cell_a"), F.greatest("cell", "cause_cell").alias("cell_b")).agg(F.count("*").alias("n"))
    return pairs.join(n, ["cell_a", "cell_b"], "left").select("cell_a", "cell_b", F.coalesce("n", F.lit(0)).alias("n_links"))


@query(f"WITH {_PEAKS}, {_EDGES}, {_LINKS}, w AS (SELECT cause_cell, cell, count(*) AS weight FROM links GROUP BY ALL) SELECT * FROM w WHERE weight >= (SELECT quantile_cont(weight, 0.9) FROM w)")
def percentile_edges(spark, d):
    w = _links(spark, d).groupBy("cause_cell", "cell").agg(F.count("*").alias("weight"))
    return w.crossJoin(F.broadcast(stats.quantiles(w, [], "weight", {"bar": 0.9}))).filter("weight >= bar").drop("bar")


@query(f"WITH {_PEAKS} SELECT cell, count(*) AS n_peaks, count(DISTINCT dataset) AS n_datasets, round(CAST(sum(CAST(height AS DECIMAL(18, 4))) AS DOUBLE) / count(*), 6) AS mean_height, max(dur) AS max_dur, round(count(*) / 720.0, 9) AS frequency FROM peaks GROUP BY cell")
def cell_metadata(spark, d):
    # Summed as decimals, so that the mean does not hang on the order of rows.
    n, total = F.count("*"), F.sum(F.col("height").cast("decimal(18,4)")).cast("double")
    return peaks(spark, d).groupBy("cell").agg(n.alias("n_peaks"), F.countDistinct("dataset").alias("n_datasets"), F.round(total / n, 6).alias("mean_height"), F.max("dur").alias("max_dur"), F.round(n / 720.0, 9).alias("frequency"))


@query(f"WITH {_PEAKS} SELECT a.event_id AS a_id, b.event_id AS b_id, least(a.frame + a.dur, b.frame + b.dur) - greatest(a.frame, b.frame) AS shared FROM peaks a JOIN peaks b ON a.cell = b.cell AND a.event_id < b.event_id AND least(a.frame + a.dur, b.frame + b.dur) - greatest(a.frame, b.frame) >= 2")
def interval_overlap(spark, d):
    p = peaks(spark, d)
    # The interval that starts later starts inside the other one, so one side is spread over the buckets it covers.
    a = p.select(F.col("event_id").alias("a"), "cell", F.col("frame").alias("af"), (F.col("frame") + F.col("dur")).alias("ae"))
    b = p.select(F.col("event_id").alias("b"), "cell", F.col("frame").alias("bf"), (F.col("frame") + F.col("dur")).alias("be"))
    met = joins.range_join(a, b, ["cell"], "af", "ae", "bf", 16).filter((F.col("af") < F.col("bf")) | ((F.col("af") == F.col("bf")) & (F.col("a") < F.col("b"))))
    shared = F.least("ae", "be") - F.col("bf")
    return met.filter(shared >= 2).select(F.least("a", "b").alias("a_id"), F.greatest("a", "b").alias("b_id"), shared.alias("shared"))


@query(f"WITH {_PEAKS}, g AS (SELECT dataset, cell, frame - lag(frame) OVER (PARTITION BY dataset, cell ORDER BY frame, event_id) AS gap FROM peaks) SELECT dataset, count(gap) AS n_gaps, round(avg(gap), 6) AS mean_gap, round(stddev_pop(gap) / avg(gap), 6) AS cv FROM g GROUP BY dataset")
def peak_intervals(spark, d):
    w = Window.partitionBy("dataset", "cell").orderBy("frame", "event_id")
    g = peaks(spark, d).withColumn("gap", F.col("frame") - F.lag("frame").over(w))
    return g.groupBy("dataset").agg(F.count("gap").alias("n_gaps"), F.round(F.avg("gap"), 6).alias("mean_gap"), F.round(F.stddev_pop("gap") / F.avg("gap"), 6).alias("cv"))


@query(f"""WITH {_PEAKS}, k AS (SELECT max(frame) + 1 AS len, count(DISTINCT cell) AS n FROM peaks), w AS (SELECT DISTINCT dataset, unnest(range(0, (SELECT len FROM k) - 199, 50)) AS start_frame FROM peaks)
SELECT w.dataset, start_frame, count(p.event_id) AS n_peaks, round(count(p.event_id) / (200.0 * any_value(n)), 9) AS rate FROM k, w LEFT JOIN peaks p ON p.dataset = w.dataset AND p.frame >= start_frame AND p.frame < start_frame + 200 GROUP BY ALL""")
def sliding_rate(spark, d):
    p = peaks(spark, d)
    size = F.broadcast(p.agg((F.max("frame") - 199).alias("last_start"), F.countDistinct("cell").alias("n")))
    slot = F.floor(F.col("frame") / 50)
    counts = p.select("dataset", F.explode(F.array(*[slot - i for i in range(4)])).alias("slot")).groupBy("dataset", "slot").agg(F.count("*").alias("c"))
    # Full windows only, those without a peak included.
    spine = p.select("dataset").distinct().crossJoin(size).filter("last_start >= 0")
    spine = spine.select("dataset", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last_start") / 50))).alias("slot"))
    n = F.coalesce("c", F.lit(0))
    return spine.join(counts, ["dataset", "slot"], "left").select("dataset", (F.col("slot") * 50).alias("start_frame"), n.alias("n_peaks"), F.round(n / (200.0 * F.col("n")), 9).alias("rate"))


@query(f"WITH {_PEAKS}, t AS (SELECT cell, frame, sum(height) AS v FROM peaks GROUP BY ALL), x AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM t WINDOW w AS (PARTITION BY cell ORDER BY frame)) SELECT cell, frame, round(v, 6) AS height FROM x WHERE v > a AND v > b")
def local_maxima(spark, d):
    w = Window.partitionBy("cell").orderBy("frame")
    t = peaks(spark, d).groupBy("cell", "frame").agg(F.sum("height").alias("v")).withColumns({"a": F.lag("v").over(w), "b": F.lead("v").over(w)})
    return t.filter("v > a AND v > b").select("cell", "frame", F.round("v", 6).alias("height"))


@query(f"WITH {_PEAKS} SELECT event_id, round((height - min(height) OVER w) / nullif(max(height) OVER w - min(height) OVER w, 0), 9) AS scaled, round((height - avg(height) OVER w) / nullif(stddev_pop(height) OVER w, 0), 6) AS z FROM peaks WINDOW w AS (PARTITION BY cell)")
def normalised_heights(spark, d):
    p = peaks(spark, d)
    s = p.groupBy("cell").agg(F.min("height").alias("lo"), F.max("height").alias("hi"), F.avg("height").alias("m"), F.stddev_pop("height").alias("s"))
    span, dev = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.nullif("s", F.lit(0.0))
    return p.join(s, "cell").select("event_id", F.round((F.col("height") - F.col("lo")) / span, 9).alias("scaled"), F.round((F.col("height") - F.col("m")) / dev, 6).alias("z"))


@query("SELECT 'region' AS kind, r_regionkey AS key, r_name AS name FROM region UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation")
def scan_union_label(spark, d):
    r = table(spark, d, "region").select(F.lit("region").alias("kind"), F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    return r.unionByName(table(spark, d, "nation").select(F.lit("nation").alias("kind"), F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")))


@query("SELECT o_orderkey, c_mktsegment, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def dim_enrich_merge(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_mktsegment", "n_name")


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def lookup_density(spark, d):
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS big FROM customer")
def mark_join(spark, d):
    big = table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.mark_join(table(spark, d, "customer").select("c_custkey"), big, "c_custkey", "big")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def semi_cohort(spark, d):
    rich = table(spark, d, "customer").filter("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(rich, "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def set_difference(spark, d):
    return table(spark, d, "customer").select("c_custkey").subtract(table(spark, d, "orders").filter("o_totalprice > 300000").select("o_custkey"))


@query("SELECT CAST(least(floor(l_extendedprice / 5000), 19) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def histogram_width(spark, d):
    return table(spark, d, "lineitem").groupBy(F.least(F.floor(F.col("l_extendedprice") / 5000), F.lit(19)).alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, round(stddev(o_totalprice), 4) AS sd, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1")
def group_summary(spark, d):
    v, o = "o_totalprice", table(spark, d, "orders").select("o_orderpriority", "o_totalprice")
    sums = o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev(v), 4).alias("sd"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    return sums.join(stats.quantiles(o, ["o_orderpriority"], v, {"median": 0.5}), "o_orderpriority").withColumn("median", F.round("median", 4))


@query("WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders GROUP BY 1) SELECT o_orderkey, o_totalprice < a - 0.5 * (b - a) OR o_totalprice > b + 0.5 * (b - a) AS outlier FROM orders JOIN q USING (o_orderpriority)")
def iqr_outliers(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return stats.iqr_split(o, "o_totalprice", ["o_orderpriority"], 0.5, 0.5).select("o_orderkey", (~F.col("inlier")).alias("outlier"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM lineitem GROUP BY 1, 2")
def share_of_total(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("t")))).select("l_returnflag", "l_linestatus", "n", F.round(F.col("n") / F.col("t"), 9).alias("share"))


@query("SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o FROM lineitem GROUP BY 1")
def category_pivot(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_linestatus") == "F").alias("f"), F.count_if(F.col("l_linestatus") == "O").alias("o"))


@query("""WITH r AS (SELECT o_orderpriority AS g, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS rk FROM orders),
p AS (SELECT g, count(*) AS n, sum(rk) AS s FROM r GROUP BY g), t AS (SELECT sum(c * c * c - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM orders GROUP BY o_totalprice)), a AS (SELECT sum(n)::DOUBLE AS n, sum(s * s / n) AS s, count(*) AS k FROM p)
SELECT round((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - t / (n * n * n - n)), 6) AS h, CAST(n AS BIGINT) AS n, k FROM a, t""")
def kruskal(spark, d):
    return stats.kruskal(table(spark, d, "orders"), "o_orderpriority", "o_totalprice")


@query("""WITH x AS (SELECT c_acctbal AS v FROM customer WHERE c_mktsegment = 'BUILDING'), y AS (SELECT c_acctbal AS v FROM customer WHERE c_mktsegment = 'MACHINERY')
SELECT round(avg(CASE WHEN x.v > y.v THEN 1.0 WHEN x.v < y.v THEN -1.0 ELSE 0.0 END), 9) AS delta FROM x, y""")
def cliffs_delta(spark, d):
    # From rank sums, without pairs: U = R - n(n+1)/2 and delta = 2U/(nm) - 1.
    c = table(spark, d, "customer").filter("c_mktsegment IN ('BUILDING', 'MACHINERY')").select("c_mktsegment", "c_acctbal")
    mine = F.col("c_mktsegment") == "BUILDING"
    s = stats.mid_ranks(c, "c_mktsegment", "c_acctbal").agg(F.sum(F.when(mine, F.col("n") * F.col("mid"))).alias("r"), F.sum(F.when(mine, F.col("n"))).alias("n"), F.sum(F.when(~mine, F.col("n"))).alias("m"))
    return s.select(F.round(2 * (F.col("r") - F.col("n") * (F.col("n") + 1) / 2) / (F.col("n") * F.col("m")) - 1, 9).alias("delta"))


@query("SELECT round(corr(p_size, p_retailprice), 9) AS r, round(regr_slope(p_retailprice, p_size), 6) AS slope, round(regr_intercept(p_retailprice, p_size), 6) AS intercept FROM part")
def linear_fit(spark, d):
    return table(spark, d, "part").agg(F.round(F.corr("p_size", "p_retailprice"), 9).alias("r"), F.round(F.regr_slope("p_retailprice", "p_size"), 6).alias("slope"), F.round(F.regr_intercept("p_retailprice", "p_size"), 6).alias("intercept"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_values(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))
