"""Statistical queries: moments, binned summaries, rank correlation, pair tests and adjusted p-values, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewave.functions import inversions, special, stats
from tidewave.plans.catalog import query, rows_only
from tidewave.sources.tables import table


@query("""SELECT o_orderpriority, count(*) AS n, round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.75), 4) AS q3,
round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 4) AS iqr, round(skewness(o_totalprice), 6) AS skew, round(kurtosis(o_totalprice), 6) AS excess_kurtosis FROM orders GROUP BY 1""")
def summary_moments(spark, d):
    v, n, o = "o_totalprice", F.count("*"), table(spark, d, "orders").select("o_orderpriority", "o_totalprice")
    # Corrected for bias; too few rows give null.
    skew = F.when(n > 2, F.skewness(v) * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(v) + 6))
    sums = o.groupBy("o_orderpriority").agg(n.alias("n"), F.round(skew, 6).alias("skew"), F.round(kurt, 6).alias("excess_kurtosis"))
    q = stats.quantiles(o, ["o_orderpriority"], v, {"q1": 0.25, "q3": 0.75})
    return sums.join(q, "o_orderpriority").select("o_orderpriority", "n", F.round("q1", 4).alias("q1"), F.round("q3", 4).alias("q3"), F.round(F.col("q3") - F.col("q1"), 4).alias("iqr"), "skew", "excess_kurtosis")


@query("""WITH b AS (SELECT CAST(floor(l_quantity / 10) AS BIGINT) AS x, CAST(floor(l_discount * 100 / 2 + 1e-9) AS BIGINT) AS y, l_extendedprice AS v FROM lineitem)
SELECT x, y, count(v) AS n, round(avg(v), 4) AS mean_value FROM (SELECT unnest(range(0, 6)) AS x) CROSS JOIN (SELECT unnest(range(0, 6)) AS y) LEFT JOIN b USING (x, y) GROUP BY ALL""")
def heatmap_2d(spark, d):
    b = table(spark, d, "lineitem").select(F.floor(F.col("l_quantity") / 10).alias("x"), F.floor(F.col("l_discount") * 100 / 2 + 1e-9).alias("y"), F.col("l_extendedprice").alias("v"))
    cells = b.groupBy("x", "y").agg(F.count("v").alias("n"), F.round(F.avg("v"), 4).alias("mean_value"))
    grid = spark.range(36).select(F.floor(F.col("id") / 6).alias("x"), (F.col("id") % 6).alias("y"))
    return grid.join(cells, ["x", "y"], "left").select("x", "y", F.coalesce("n", F.lit(0)).alias("n"), "mean_value")


@query("""WITH e AS (SELECT quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.5) AS b, quantile_cont(p_retailprice, 0.75) AS c FROM part)
SELECT CAST(CASE WHEN p_retailprice <= a THEN 0 WHEN p_retailprice <= b THEN 1 WHEN p_retailprice <= c THEN 2 ELSE 3 END AS INT) AS bin, count(*) AS n, round(avg(p_retailprice), 4) AS mean_x, round(median(p_size), 4) AS median_y, round(any_value((SELECT corr(p_retailprice, p_size) FROM part)), 9) AS correlation FROM part, e GROUP BY 1""")
def quantile_bins(spark, d):
    p = table(spark, d, "part").select("p_retailprice", "p_size")
    edges = stats.quantiles(p, [], "p_retailprice", {"e1": 0.25, "e2": 0.5, "e3": 0.75})
    binned = p.crossJoin(F.broadcast(edges)).withColumn("bin", sum((F.col("p_retailprice") > F.col(e)).cast("int") for e in ("e1", "e2", "e3")))
    means = binned.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("mean_x"))
    both = means.join(stats.quantiles(binned, ["bin"], "p_size", {"median_y": 0.5}), "bin").withColumn("median_y", F.round("median_y", 4))
    return both.crossJoin(F.broadcast(p.agg(F.round(F.corr("p_retailprice", "p_size"), 9).alias("correlation"))))


@query("""WITH r AS (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS b FROM part)
SELECT round(corr(a, b), 9) AS rho, count(*) AS n FROM r""")
def spearman(spark, d):
    p = table(spark, d, "part").select("p_size", "p_retailprice", F.lit(1).alias("g"))
    a, b = (stats.mid_ranks(p, "g", c).select(c, F.col("mid").alias(f"{c}_rank")) for c in ("p_size", "p_retailprice"))
    return p.join(a, "p_size").join(b, "p_retailprice").agg(F.round(F.corr("p_size_rank", "p_retailprice_rank"), 9).alias("rho"), F.count("*").alias("n"))


@query("""WITH c AS (SELECT p_size AS x, p_retailprice AS y, count(*) AS n FROM part GROUP BY ALL),
s AS (SELECT sum(a.n * b.n) AS s FROM c a JOIN c b ON b.x < a.x AND b.y < a.y), t AS (SELECT sum(a.n * b.n) AS t FROM c a JOIN c b ON b.x < a.x AND b.y > a.y),
u AS (SELECT sum(k * (k - 1) / 2) AS u FROM (SELECT sum(n) AS k FROM c GROUP BY x)), v AS (SELECT sum(k * (k - 1) / 2) AS v FROM (SELECT sum(n) AS k FROM c GROUP BY y)), w AS (SELECT sum(n) * (sum(n) - 1) / 2 AS w FROM c)
SELECT round((s - t) / nullif(sqrt((w - u) * (w - v)), 0), 9) AS tau_b FROM s, t, u, v, w""")
def kendall(spark, d):
    return inversions.kendall(table(spark, d, "part"), "p_size", "p_retailprice").select(F.round("tau_b", 9).alias("tau_b"))


@query("""WITH s AS (SELECT (b.s_acctbal - a.s_acctbal) / (b.s_suppkey - a.s_suppkey) AS k FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey), n AS (SELECT count(*) AS n FROM supplier), z AS (SELECT 1.959963984540054 * sqrt(n * (n - 1) * (2 * n + 5) / 18.0) AS c, n * (n - 1) / 2 AS t FROM n),
m AS (SELECT median(k) AS slope, list_sort(list(k)) AS ks FROM s) SELECT round(slope, 6) AS slope, round((SELECT median(s_acctbal) FROM supplier) - slope * (SELECT median(s_suppkey) FROM supplier), 4) AS intercept,
round(ks[CAST(greatest(round((t - c) / 2), 1) AS BIGINT)], 6) AS lo_slope, round(ks[CAST(least(round((t + c) / 2), t) AS BIGINT)], 6) AS hi_slope FROM m, z""")
def theil_sen(spark, d):
    return stats.theil_sen(table(spark, d, "supplier"), "s_suppkey", "s_acctbal")


@query("""WITH x AS (SELECT c_acctbal AS v FROM customer WHERE c_mktsegment = 'BUILDING'), y AS (SELECT c_acctbal AS v FROM customer WHERE c_mktsegment = 'MACHINERY')
SELECT round(avg(CASE WHEN x.v > y.v THEN 1.0 WHEN x.v < y.v THEN 0.0 ELSE 0.5 END), 9) AS a, round(sum(CASE WHEN x.v > y.v THEN 1.0 WHEN x.v < y.v THEN 0.0 ELSE 0.5 END), 1) AS u FROM x, y""")
def rank_sum_effect(spark, d):
    c = table(spark, d, "customer").filter("c_mktsegment IN ('BUILDING', 'MACHINERY')").select("c_mktsegment", "c_acctbal")
    mine = F.col("c_mktsegment") == "BUILDING"
    s = stats.mid_ranks(c, "c_mktsegment", "c_acctbal").agg(F.sum(F.when(mine, F.col("n") * F.col("mid"))).alias("r"), F.sum(F.when(mine, F.col("n"))).alias("n"), F.sum(F.when(~mine, F.col("n"))).alias("m"))
    u = F.col("r") - F.col("n") * (F.col("n") + 1) / 2
    return s.select(F.round(u / (F.col("n") * F.col("m")), 9).alias("a"), F.round(u, 1).alias("u"))


_DUNN = """WITH r AS (SELECT o_orderpriority AS g, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS rk FROM orders),
p AS (SELECT g, count(*)::DOUBLE AS n, avg(rk) AS m FROM r GROUP BY g), t AS (SELECT sum(c * c * c - c) AS t FROM (SELECT count(*)::DOUBLE AS c FROM orders GROUP BY o_totalprice)), a AS (SELECT sum(n) AS n FROM p)
SELECT x.g AS group_a, y.g AS group_b, round((x.m - y.m) / sqrt((a.n * (a.n + 1) / 12 - t / (12 * (a.n - 1))) * (1 / x.n + 1 / y.n)), 6) AS z FROM p x JOIN p y ON x.g < y.g, t, a"""


def _dunn(spark, d):
    return stats.dunn(table(spark, d, "orders"), "o_orderpriority", "o_totalprice")


@query(_DUNN)
def dunn_pairs(spark, d):
    return _dunn(spark, d).withColumn("z", F.round("z", 6))


@rows_only
def dunn_adjusted(spark, d):
    """Two-sided p-values of the pairs of groups, adjusted. The normal tail has no SQL form."""
    tests = _dunn(spark, d).withColumn("p", special.column(special.normal_two_sided)("z"))
    return stats.rejected(stats.adjust(tests, "p", ["group_a", "group_b"]), ["none", "holm", "fdr_bh"])


_SEGMENTS = "(x.c_mktsegment, y.c_mktsegment) IN (('BUILDING', 'MACHINERY'), ('AUTOMOBILE', 'FURNITURE'))"
_TESTED = (("BUILDING", "MACHINERY"), ("AUTOMOBILE", "FURNITURE"))


def _each(f, spark, d):
    c = table(spark, d, "customer").select("c_mktsegment", "c_acctbal")
    out = None
    for a, b in _TESTED:
        part = f(c, "c_mktsegment", "c_acctbal", a, b)
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH u AS (SELECT x.c_mktsegment AS group_a, y.c_mktsegment AS group_b, sum(CASE WHEN x.c_acctbal > y.c_acctbal THEN 1.0 WHEN x.c_acctbal = y.c_acctbal THEN 0.5 ELSE 0 END) AS u FROM customer x, customer y WHERE {_SEGMENTS} GROUP BY ALL),
k AS (SELECT u.*, (SELECT count(*) FROM customer WHERE c_mktsegment = group_a)::DOUBLE AS n, (SELECT count(*) FROM customer WHERE c_mktsegment = group_b)::DOUBLE AS m,
 (SELECT sum(c * c * c - c) FROM (SELECT count(*)::DOUBLE AS c FROM customer WHERE c_mktsegment IN (group_a, group_b) GROUP BY c_acctbal)) AS t FROM u)
SELECT group_a, group_b, CAST(n AS BIGINT) AS n, CAST(m AS BIGINT) AS m, round(u, 1) AS u, round((greatest(u, n * m - u) - n * m / 2 - 0.5) / sqrt(n * m / 12 * ((n + m + 1) - t / ((n + m) * (n + m - 1)))), 6) AS z FROM k""")
def mann_whitney(spark, d):
    return _each(stats.mann_whitney, spark, d).select("group_a", "group_b", "n", "m", F.round("u", 1).alias("u"), F.round("z", 6).alias("z"))


@rows_only
def mann_whitney_p(spark, d):
    """Two-sided p: exact where one of the groups has 20 members or fewer and there are no ties, else from the normal score."""
    found = _each(stats.mann_whitney, spark, d)

    def p(u, z, n, m, untied):
        return special.exact_u_tail(int(u), int(n), int(m)) if untied and min(n, m) <= 20 else min(1.0, special.normal_two_sided(max(z, 0.0)))

    out = found.withColumn("p", special.column(p)("u", "z", "n", "m", "untied")).drop("untied")
    return stats.adjust(out, "p", ["group_a", "group_b"])


@query(f"""WITH c AS (SELECT c_custkey, c_mktsegment AS g, c_acctbal AS v FROM customer), p AS (SELECT * FROM (VALUES ('BUILDING', 'MACHINERY'), ('AUTOMOBILE', 'FURNITURE')) AS t(group_a, group_b)),
r AS (SELECT group_a, group_b, g, rank() OVER w + (count(*) OVER (PARTITION BY group_a, v) - 1) / 2.0 AS pooled, rank() OVER i + (count(*) OVER (PARTITION BY group_a, g, v) - 1) / 2.0 AS own FROM p JOIN c ON g IN (group_a, group_b) WINDOW w AS (PARTITION BY group_a ORDER BY v), i AS (PARTITION BY group_a, g ORDER BY v)),
m AS (SELECT group_a, group_b, g, count(*)::DOUBLE AS n, avg(pooled) AS mean FROM r GROUP BY ALL), s AS (SELECT m.*, (SELECT sum((r.pooled - r.own - m.mean + (m.n + 1) / 2) ** 2) FROM r WHERE r.group_a = m.group_a AND r.g = m.g) / (n - 1) AS s FROM m),
k AS (SELECT a.group_a, a.group_b, a.n AS n, b.n AS m, a.mean AS ma, b.mean AS mb, a.s AS sa, b.s AS sb FROM s a JOIN s b ON a.group_a = b.group_a AND a.g = a.group_a AND b.g = b.group_b)
SELECT group_a, group_b, round(n * m * (mb - ma) / ((n + m) * sqrt(n * sa + m * sb)), 6) AS statistic, round((n * sa + m * sb) ** 2 / ((n * sa) ** 2 / (n - 1) + (m * sb) ** 2 / (m - 1)), 4) AS df FROM k""")
def brunner_munzel(spark, d):
    return _each(stats.brunner_munzel, spark, d).select("group_a", "group_b", F.round("statistic", 6).alias("statistic"), F.round("df", 4).alias("df"))


@rows_only
def brunner_munzel_p(spark, d):
    """Two-sided p from Student's distribution, adjusted over the pairs."""
    out = _each(stats.brunner_munzel, spark, d).withColumn("p", special.column(special.student_two_sided)("statistic", "df"))
    return stats.rejected(stats.adjust(out, "p", ["group_a", "group_b"]), ["none", "holm", "fdr_bh"])


@query(f"SELECT group_a, group_b, round((SELECT median(c_acctbal) FROM customer WHERE c_mktsegment = group_a) - (SELECT median(c_acctbal) FROM customer WHERE c_mktsegment = group_b), 4) AS estimate FROM (VALUES ('BUILDING', 'MACHINERY'), ('AUTOMOBILE', 'FURNITURE')) AS t(group_a, group_b)")
def median_difference(spark, d):
    c = table(spark, d, "customer").select("c_mktsegment", "c_acctbal")
    m = stats.quantiles(c, ["c_mktsegment"], "c_acctbal", {"m": 0.5})
    pairs = spark.createDataFrame(list(_TESTED), "group_a string, group_b string")
    a, b = m.toDF("group_a", "ma"), m.toDF("group_b", "mb")
    return F.broadcast(pairs).join(a, "group_a").join(b, "group_b").select("group_a", "group_b", F.round(F.col("ma") - F.col("mb"), 4).alias("estimate"))


@rows_only
def median_intervals(spark, d):
    """Median of each segment with its bootstrap interval."""
    import numpy as np

    return stats.bootstrap(table(spark, d, "customer"), ["c_mktsegment"], ["c_acctbal"], np.median)


@rows_only
def correlation_interval(spark, d):
    """Spearman's rho of each brand's sizes and prices with its bootstrap interval, pairs drawn together."""
    import numpy as np
    import pandas as pd

    def rho(x, y):
        a, b = pd.Series(x).rank().to_numpy(), pd.Series(y).rank().to_numpy()
        return float(np.corrcoef(a, b)[0, 1]) if a.std() and b.std() else float("nan")

    return stats.bootstrap(table(spark, d, "part"), ["p_brand"], ["p_size", "p_retailprice"], rho)


@rows_only
def kruskal_p(spark, d):
    """H with its tail of the chi-square distribution."""
    h = stats.kruskal(table(spark, d, "orders"), "o_orderpriority", "o_totalprice")
    return h.withColumn("p", special.column(lambda h, k: special.gamma_rest((k - 1) / 2, h / 2))("h", "k"))


@query("""WITH p AS (SELECT CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part), m AS (SELECT count(*) AS n, sum(x) AS s1, sum(x ** 2) AS s2, sum(x ** 3) AS s3, sum(x ** 4) AS s4, sum(y) AS t0, sum(x * y) AS t1, sum(x * x * y) AS t2 FROM p),
d AS (SELECT *, n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det FROM m)
SELECT round((t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / det, 4) AS c0, round((n * (t1 * s4 - t2 * s3) - t0 * (s1 * s4 - s2 * s3) + s2 * (s1 * t2 - s2 * t1)) / det, 5) AS c1, round((n * (s2 * t2 - s3 * t1) - s1 * (s1 * t2 - s2 * t1) + t0 * (s1 * s3 - s2 * s2)) / det, 6) AS c2 FROM d""")
def polynomial_fit(spark, d):
    """A parabola by sums of powers, which add up over all tasks."""
    p = table(spark, d, "part").select(F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    s = [F.sum(F.col("x") ** k) for k in range(5)]
    t = [F.sum(F.col("x") ** k * F.col("y")) for k in range(3)]
    m = p.agg(*[c.alias(f"s{k}") for k, c in enumerate(s)], *[c.alias(f"t{k}") for k, c in enumerate(t)])
    minor = lambda r: r[0] * (r[4] * r[8] - r[5] * r[7]) - r[1] * (r[3] * r[8] - r[5] * r[6]) + r[2] * (r[3] * r[7] - r[4] * r[6])
    rows = [[F.col(f"s{i + j}") for j in range(3)] for i in range(3)]
    det = minor([c for r in rows for c in r])
    out = []
    for k in range(3):
        swapped = [[F.col(f"t{i}") if j == k else rows[i][j] for j in range(3)] for i in range(3)]
        out.append(F.round(minor([c for r in swapped for c in r]) / det, 4 + k).alias(f"c{k}"))
    return m.select(*out)


@query("""WITH p AS (SELECT c_nationkey AS k, count(*) FILTER (c_acctbal < 0) / CAST(count(*) AS DOUBLE) / 5 AS p FROM customer GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p, k) AS i, count(*) OVER () AS m FROM p),
q AS (SELECT *, min(least(1, m * p / i)) OVER (ORDER BY i DESC) AS bh FROM r), simes AS (SELECT s, min(s * p / (i - m + s)) AS c FROM r, (SELECT unnest(range(1, (SELECT count(*) FROM r) + 1)) AS s) WHERE i > m - s GROUP BY s),
hom AS (SELECT i, greatest(max(p), max(CASE WHEN i > m - s THEN c ELSE least(s * p, c) END)) AS hommel FROM r, simes GROUP BY i)
SELECT k, round(p, 9) AS p, round(least(1, m * p), 9) AS bonferroni, round(1 - pow(1 - p, m), 9) AS sidak, round(max(least(1, (m - i + 1) * p)) OVER (ORDER BY i), 9) AS holm,
round(min(least(1, m * p / i)) OVER (ORDER BY i DESC), 9) AS fdr_bh, round(max(1 - pow(1 - p, m - i + 1)) OVER (ORDER BY i), 9) AS holm_sidak, round(min(least(1, (m - i + 1) * p)) OVER (ORDER BY i DESC), 9) AS simes_hochberg,
round(min(least(1, (SELECT sum(1.0 / i) FROM r) * m * p / i)) OVER (ORDER BY i DESC), 9) AS fdr_by, round(hommel, 9) AS hommel,
round(least(1, bh * CASE WHEN first_bh BETWEEN 1 AND m - 1 THEN m - first_bh ELSE m END / m), 9) AS fdr_tsbh, round(least(1, 1.05 * bh * CASE WHEN first_bky BETWEEN 1 AND m - 1 THEN m - first_bky ELSE m END / m), 9) AS fdr_tsbky, bh <= 0.05 AS reject
FROM (SELECT q.*, (SELECT count(*) FROM q x WHERE x.bh <= 0.05) AS first_bh, (SELECT count(*) FROM q x WHERE x.bh <= 0.05 / 1.05) AS first_bky, hommel FROM q JOIN hom USING (i)) ORDER BY p, k""")
def adjusted_p_values(spark, d):
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg((F.count_if(F.col("c_acctbal") < 0) / F.count("*") / 5).alias("p"))
    out = stats.adjust(c, "p", ["k"])
    return out.select("k", *[F.round(x, 9).alias(x) for x in ("p", "bonferroni", "sidak", "holm", "fdr_bh", "holm_sidak", "simes_hochberg", "fdr_by", "hommel", "fdr_tsbh", "fdr_tsbky")], (F.col("fdr_bh") <= 0.05).alias("reject"))
