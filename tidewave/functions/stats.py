"""Rank statistics as relations. Ranks come from counts per value, so ties share one row and windows stay short."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.operators.graph import cut


#: Bins by which order statistics are narrowed down.
BINS = 2048
#: Rows a block holds on average where all pairs of rows are met.
BLOCK = 2048


def quantiles(rows: DataFrame, groups: list[str], value: str, parts: dict[str, float]) -> DataFrame:
    """(groups, one column a part): exact quantiles with linear interpolation of each group's values that are not null. Null is a group.

    No task holds a group: values are counted, a histogram of ``BINS`` bins a group finds the bins that hold the two order statistics
    around each part, and only the values of those bins are put in order.
    """
    keys = [f"_g{i}" for i in range(len(groups))]
    named = rows.select(*[F.col(g).alias(k) for g, k in zip(groups, keys)], F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    counts = named.groupBy(*keys, "_v").agg(F.count("*").alias("_n"))
    ends = named.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_total"))

    def match(a: DataFrame, b: DataFrame, extra: list[str], small: bool = True) -> DataFrame:
        right = b.select(*[F.col(c).alias(f"_r{c}") for c in [*keys, *extra]], *[c for c in b.columns if c not in [*keys, *extra]])
        on = [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys] + [F.col(c) == F.col(f"_r{c}") for c in extra]
        right = F.broadcast(right) if small else right
        joined = a.join(right, on) if on else a.crossJoin(right)
        return joined.drop(*[f"_r{c}" for c in [*keys, *extra]])

    few = not groups
    width = F.nullif((F.col("_hi") - F.col("_lo")) / BINS, F.lit(0.0))
    at = F.coalesce(F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(BINS - 1)), F.lit(0))
    binned = match(counts, ends, [], few).withColumn("_bin", at)
    upto = Window.partitionBy(*keys).orderBy("_bin")
    bars = binned.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_m"), F.first("_total").alias("_all"))
    bars = bars.withColumn("_before", F.sum("_m").over(upto) - F.col("_m"))
    wanted = F.array(*[F.floor(F.lit(p) * (F.col("_all") - 1) + step) for p in parts.values() for step in (0, 1)])
    mine = F.filter(wanted, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_m")))
    picks = bars.filter(F.size(mine) > 0).select(*keys, "_bin", "_before")
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v")
    ordered = match(binned.select(*keys, "_v", "_n", "_bin", "_total"), picks, ["_bin"], few).withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
    out = []
    for name, p in parts.items():
        rank = F.lit(p) * (F.col("_total") - 1)
        value_at = lambda r: F.max(F.when((r >= F.col("_upto") - F.col("_n")) & (r < F.col("_upto")), F.col("_v")))
        lo, hi = value_at(F.floor(rank)), value_at(F.floor(rank) + 1)
        out.append((lo + (F.coalesce(hi, lo) - lo) * (F.max(rank) - F.floor(F.max(rank)))).alias(name))
    return ordered.groupBy(*keys).agg(*out).select(*[F.col(k).alias(g) for g, k in zip(groups, keys)], *parts)


def iqr_split(rows: DataFrame, value: str, groups: list[str], k_lower: float, k_upper: float) -> DataFrame:
    """``rows`` with lower, upper (fences of the row's group, ends included, null being a group) and inlier. Values are read as numbers; others are null, and such rows go."""
    number = rows.withColumn(value, F.col(value).try_cast("double")).filter(F.col(value).isNotNull())
    q = quantiles(number, groups, value, {"_q1": 0.25, "_q3": 0.75})
    fences = q.select(*[F.col(g).alias(f"_f{g}") for g in groups], (F.col("_q1") - k_lower * (F.col("_q3") - F.col("_q1"))).alias("lower"), (F.col("_q3") + k_upper * (F.col("_q3") - F.col("_q1"))).alias("upper"))
    on = [F.col(g).eqNullSafe(F.col(f"_f{g}")) for g in groups]
    out = number.join(fences, on) if on else number.crossJoin(F.broadcast(fences))
    return out.drop(*[f"_f{g}" for g in groups]).withColumn("inlier", F.col(value).between(F.col("lower"), F.col("upper")))


def pair_distances(points: DataFrame) -> DataFrame:
    """(mean_distance, max_distance) over all pairs of ``points`` (x, y).

    Points are counted by place, and places held by columns, the lines along the axis with fewer different values. Two columns are met at a time,
    and pairs of them counted by their offset, so n places of a column and of another take n log n steps, however many points lie there, and are
    never rows. Columns whose places are not on even steps are compared place by place. Without a pair both are null.
    """
    places = cut(points.groupBy("x", "y").agg(F.count("*").alias("n")))
    size = places.agg(F.sum("n").alias("k"), F.countDistinct("x").alias("x"), F.countDistinct("y").alias("y")).first()
    of, along = ("x", "y") if size["x"] <= size["y"] else ("y", "x")
    columns = places.groupBy(F.col(of).cast("double").alias("at")).agg(F.array_sort(F.collect_list(F.struct(F.col(along).cast("double").alias("v"), "n"))).alias("held"))

    @F.pandas_udf("s double, m double")
    def met(dx: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_column_distances(d, p, q) for d, p, q in zip(dx, a, b)], columns=["s", "m"])

    # Few rows hold much work, so they are dealt to as many tasks as shuffles have.
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = columns.toDF("a", "p").join(F.broadcast(columns.toDF("b", "q")), F.col("a") <= F.col("b")).repartition(tasks, "a", "b")
    sums = pairs.select(met(F.col("b") - F.col("a"), "p", "q").alias("o")).agg(F.sum("o.s").alias("s"), F.max("o.m").alias("m"))
    k = size["k"] or 0
    some = lambda c: F.round(F.when(F.lit(k > 1), c), 6)
    return sums.select(some(F.col("s") / max(k * (k - 1) / 2.0, 1.0)).alias("mean_distance"), some(F.col("m")).alias("max_distance"))


#: Steps a column may span for each of its places, to be laid out on them, and pairs of places compared at once otherwise.
SPARSE, AT_ONCE = 64, 1 << 20


def _column_distances(dx: float, p, q) -> tuple[float, float]:
    """(sum, greatest) of the distances of the points of two columns ``dx`` apart, each a list of (v, n): places and points there. Pairs within one column count once."""
    (v, n), (w, m) = (np.array([(r["v"], r["n"]) for r in side], float).T for side in (p, q))
    far = float(np.hypot(dx, max(v[-1] - w[0], w[-1] - v[0])))
    first, steps = min(v[0], w[0]), np.unique(np.concatenate((np.diff(v), np.diff(w), [abs(v[0] - w[0])])))
    unit = steps[steps > 0].min(initial=np.inf)
    i, j = (v - first) / unit, (w - first) / unit
    span = int(max(i[-1], j[-1])) + 1
    # Counts come out of transforms as whole numbers as long as they are far below the places of a double.
    if (i == np.floor(i)).all() and (j == np.floor(j)).all() and span <= SPARSE * (len(v) + len(w)) and n.sum() * m.sum() < 1 << 44:
        a, b = np.zeros(2 * span), np.zeros(2 * span)
        a[i.astype(int)], b[j.astype(int)] = n, m
        counts = np.rint(np.fft.irfft(np.fft.rfft(b) * np.conj(np.fft.rfft(a)), 2 * span))
        off = np.minimum(np.arange(2 * span), 2 * span - np.arange(2 * span)) * (unit if np.isfinite(unit) else 0.0)
        total = float((counts * np.hypot(dx, off)).sum())
    else:
        rows = max(1, AT_ONCE // len(w))
        total = float(sum(n[k : k + rows] @ np.hypot(dx, v[k : k + rows, None] - w) @ m for k in range(0, len(v), rows)))
    return (total / 2 if dx == 0 else total), far


def mid_ranks(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n, mid): pooled mid-rank of each value. Values are numbered by lanes of their order, of like size, not in one task."""
    sums = rows.groupBy(value).agg(F.count("*").alias("n"))
    lanes = cut(sums.repartitionByRange(value).withColumn("_lane", F.spark_partition_id()))
    lead = lanes.groupBy("_lane").agg(F.sum("n").alias("m"))
    before = lead.withColumn("_lead", F.coalesce(F.sum("m").over(Window.orderBy("_lane").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("m")
    inside = Window.partitionBy("_lane").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = lanes.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(before), "_lane")
    ranked = ranked.select(value, F.col("n").alias("ties"), (F.col("_lead") + F.col("_in") + (F.col("n") + 1) / 2).alias("mid"))
    return rows.groupBy(group, value).agg(F.count("*").alias("n")).join(ranked, value)


def kruskal(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Kruskal-Wallis H with tie correction, the number of rows and of groups."""
    ranks = mid_ranks(rows, group, value)
    per = ranks.groupBy(group).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mid")).alias("r"))
    ties = ranks.select(value, "ties").distinct().agg(F.sum(F.pow("ties", F.lit(3)) - F.col("ties")).alias("t"))
    total = per.agg(F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.count("*").alias("k")).crossJoin(ties)
    # As a number of double precision: the cube of two million rows is no long.
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("t") / (n * n * n - n))
    return total.select(F.round(h, 6).alias("h"), "n", F.col("k").alias("k"))


def dunn(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group_a, group_b, z) of all pairs of groups, ties corrected. Only one row a group is paired."""
    ranks = mid_ranks(rows, group, value)
    per = ranks.groupBy(group).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mid")) / F.sum("n")).alias("m"))
    ties = ranks.select(value, "ties").distinct().agg(F.sum(F.pow("ties", F.lit(3)) - F.col("ties")).alias("t"))
    total = per.agg(F.sum("n").alias("all")).crossJoin(ties)
    a, b = per.toDF("group_a", "na", "ma"), per.toDF("group_b", "nb", "mb")
    pairs = a.join(b, F.col("group_a") < F.col("group_b")).crossJoin(F.broadcast(total))
    n = F.col("all")
    spread = (n * (n + 1) / 12 - F.col("t") / (12 * (n - 1))) * (1 / F.col("na") + 1 / F.col("nb"))
    return pairs.select("group_a", "group_b", ((F.col("ma") - F.col("mb")) / F.sqrt(spread)).alias("z"))


def adjust(tests: DataFrame, p: str, order: list[str], alpha: float = 0.05) -> DataFrame:
    """``tests`` with p-values adjusted by ten methods, named as their columns; one row a test, so one window holds all, and Hommel's takes a row a pair of tests."""
    n = tests.agg(F.count("*").alias("_m"))
    ranked = tests.crossJoin(F.broadcast(n)).withColumn("_i", F.row_number().over(Window.orderBy(p, *order)))
    at, m = F.col(p), F.col("_m")
    holm = F.max(F.least(F.lit(1.0), (m - F.col("_i") + 1) * at)).over(Window.orderBy("_i"))
    fdr = F.min(F.least(F.lit(1.0), m * at / F.col("_i"))).over(Window.orderBy(F.desc("_i")))
    # The harmonic number of the tests, and steps from the largest p down.
    upto, down = Window.orderBy("_i"), Window.orderBy(F.desc("_i"))
    holm_sidak = F.max(1 - F.pow(1 - at, m - F.col("_i") + 1)).over(upto)
    hochberg = F.min(F.least(F.lit(1.0), (m - F.col("_i") + 1) * at)).over(down)
    harmonic = F.sum(1.0 / F.col("_i")).over(Window.partitionBy(F.lit(0)))
    ranked = ranked.withColumn("_h", harmonic)
    by = F.min(F.least(F.lit(1.0), F.col("_h") * m * at / F.col("_i"))).over(down)
    out = {"bonferroni": F.least(F.lit(1.0), m * at), "sidak": 1 - F.pow(1 - at, m), "holm": holm, "fdr_bh": fdr, "holm_sidak": holm_sidak, "simes_hochberg": hochberg, "fdr_by": by}
    steps = ranked.withColumns(out)
    # Two stages: the tests the first one leaves take the place of all tests in the second, unless it leaves all or none.
    every = Window.partitionBy(F.lit(0))

    def staged(level: float, factor: float):
        gone = F.sum((F.col("fdr_bh") <= level).cast("int")).over(every)
        return F.least(F.lit(1.0), F.col("fdr_bh") * factor * F.when((gone > 0) & (gone < m), m - gone).otherwise(m) / m)

    two = steps.withColumns({"fdr_tsbh": staged(alpha, 1.0), "fdr_tsbky": staged(alpha / (1 + alpha), 1 + alpha)})
    # Hommel: of every number of largest p-values, the least Simes bound holds for those, and for smaller ones where it is below their own.
    sizes = ranked.filter("_i = 1").select(F.explode(F.sequence(F.lit(1), F.col("_m").cast("int"))).alias("_size"))
    met = ranked.select("_i", "_m", at.alias("_p")).crossJoin(F.broadcast(sizes))
    rank = F.col("_i") - (F.col("_m") - F.col("_size"))
    bound = met.filter(rank > 0).groupBy("_size").agg(F.min(F.col("_size") * F.col("_p") / rank).alias("_bound"))
    hommel = met.join(bound, "_size").groupBy("_i").agg(F.greatest(F.max("_p"), F.max(F.when(rank > 0, F.col("_bound")).otherwise(F.least(F.col("_size") * F.col("_p"), F.col("_bound"))))).alias("hommel"))
    return two.join(hommel, "_i").orderBy("_i").drop("_m", "_i", "_h")


def rejected(tests: DataFrame, methods: list[str], alpha: float = 0.05) -> DataFrame:
    """``tests`` with a flag a method: is its adjusted p at most ``alpha``? The method ``none`` rejects nothing."""
    return tests.withColumns({f"reject_{m}": F.lit(False) if m == "none" else F.col(m) <= alpha for m in methods})


def rank_sums(rows: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """One row for the groups ``a`` and ``b``: sizes n and m, rank sum r of ``a`` in the pool, and the sum of t^3 - t over ties."""
    pool = rows.filter(F.col(group).isin(a, b))
    ranks, mine = mid_ranks(pool, group, value), F.col(group) == a
    size = lambda flag: F.sum(F.when(flag, F.col("n")).otherwise(0))
    ties = ranks.select(value, "ties").distinct().agg(F.sum(F.pow("ties", F.lit(3)) - F.col("ties")).alias("t"))
    return ranks.agg(size(mine).alias("n"), size(~mine).alias("m"), F.sum(F.when(mine, F.col("n") * F.col("mid"))).alias("r")).crossJoin(F.broadcast(ties))


def mann_whitney(rows: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """(group_a, group_b, n, m, u, z): the statistic and its normal score with ties and continuity corrected."""
    n, m, t = F.col("n"), F.col("m"), F.col("t")
    u, total = F.col("r") - n * (n + 1) / 2, n + m
    spread = F.sqrt(n * m / 12 * ((total + 1) - t / (total * (total - 1))))
    off = F.greatest(u, n * m - u) - n * m / 2 - 0.5
    return rank_sums(rows, group, value, a, b).select(F.lit(a).alias("group_a"), F.lit(b).alias("group_b"), "n", "m", u.alias("u"), (off / spread).alias("z"), (t == 0).alias("untied"))


def brunner_munzel(rows: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """(group_a, group_b, statistic, df): ranks in the pool less ranks within the group are placements; their spread scales the difference."""
    pool = rows.filter(F.col(group).isin(a, b))
    ranked = mid_ranks(pool, group, value).select(F.col(group).alias("g"), F.col(value).alias("v"), "n", "mid")
    inner = []
    for g in (a, b):
        own = mid_ranks(pool.filter(F.col(group) == g), group, value)
        inner.append(own.select(F.col(group).alias("g"), F.col(value).alias("v"), F.col("mid").alias("own")))
    both = ranked.join(inner[0].union(inner[1]), ["g", "v"])
    w = F.sum(F.col("n") * F.col("mid")) / F.sum("n")
    means = both.groupBy("g").agg(F.sum("n").alias("size"), w.alias("mean"))
    off = F.col("mid") - F.col("own") - F.col("mean") + (F.col("size") + 1) / 2
    per = both.join(F.broadcast(means), "g").groupBy("g", "size", "mean").agg((F.sum(F.col("n") * off * off) / (F.col("size") - 1)).alias("s"))
    one = lambda g, c: F.max(F.when(F.col("g") == g, F.col(c)))
    k = per.agg(*[one(g, c).alias(f"{c}{i}") for i, g in enumerate((a, b)) for c in ("size", "mean", "s")])
    n, m, x, y = F.col("size0"), F.col("size1"), F.col("size0") * F.col("s0"), F.col("size1") * F.col("s1")
    stat = n * m * (F.col("mean1") - F.col("mean0")) / ((n + m) * F.sqrt(x + y))
    df = (x + y) ** 2 / (x * x / (n - 1) + y * y / (m - 1))
    return k.select(F.lit(a).alias("group_a"), F.lit(b).alias("group_b"), stat.alias("statistic"), df.alias("df"))


def bootstrap(rows: DataFrame, groups: list[str], columns: list[str], statistic, times: int = 200, alpha: float = 0.05, seed: int = 7) -> DataFrame:
    """(groups, estimate, low, high): percentile interval of ``statistic`` of a group's columns (arrays) over resamples with replacement.

    A group's sample is drawn in one task, as each resample needs all of it; groups are samples of units, not of a corpus.
    """
    import numpy as np
    import pandas as pd

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(groups).schema)

    def run(key, pdf):
        data = [pdf[c].to_numpy(float) for c in columns]
        rng, n = np.random.default_rng(seed), len(pdf)
        drawn = [statistic(*(x[at] for x in data)) for at in (rng.integers(0, n, n) for _ in range(times))]
        low, high = np.nanquantile(drawn, [alpha / 2, 1 - alpha / 2])
        return pd.DataFrame([(*key, float(statistic(*data)), float(low), float(high))], columns=[*groups, "estimate", "low", "high"])

    return rows.select(*groups, *columns).dropna(subset=columns).groupBy(*groups).applyInPandas(run, f"{kinds}, estimate double, low double, high double")


def theil_sen(rows: DataFrame, x: str, y: str, z: float = 1.959963984540054) -> DataFrame:
    """(slope, intercept, lo_slope, hi_slope): median of the slopes of all pairs of unequal ``x``, and its interval from the normal approximation.

    Slopes are made from two blocks of rows at a time and only counted, never kept: four passes count them by the next 16 bits of the numbers of the order
    statistics asked for, which are exact after the last. Time grows with the square of the rows, memory and disk do not.
    """
    p = cut(rows.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna())
    n = p.count()
    blocks = F.lit(max(1, -(-n // BLOCK))).cast("long")
    met = p.withColumn("own", F.pmod(F.xxhash64("x", "y", F.monotonically_increasing_id()), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    met = met.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "x", "y")
    places: dict[int, tuple[int, int]] = {}
    for step in range(4):
        counts = _slope_bits(met, sorted({at for at, _ in places.values()} or {0}), 48 - 16 * step)
        if not step:
            t = sum(counts.values())
            if not t:
                return rows.sparkSession.createDataFrame([(None,) * 4], "slope double, intercept double, lo_slope double, hi_slope double")
            c = F.col("c")
            ties = p.groupBy("x").agg(F.count("*").alias("c")).agg(F.sum(c * (c - 1) * (2 * c + 5))).first()[0]
            spread = z * ((n * (n - 1) * (2 * n + 5) - ties) / 18.0) ** 0.5
            low, high = (min(max(round(r), 1), t) - 1 for r in ((t - spread) / 2, (t + spread) / 2))
            places = {r: (0, r) for r in ((t - 1) // 2, t // 2, low, high)}
        for r, (at, left) in places.items():
            for (held, part), k in sorted(counts.items()):
                if held == at:
                    if left < k:
                        places[r] = ((at << 16) | part, left)
                        break
                    left -= k
    value = {r: _number(at) for r, (at, _) in places.items()}
    slope = value[(t - 1) // 2] + (value[t // 2] - value[(t - 1) // 2]) * 0.5
    mid = quantiles(p, [], "x", {"mx": 0.5}).crossJoin(quantiles(p, [], "y", {"my": 0.5}))
    rounded = lambda v, name: F.round(F.lit(v), 6).alias(name)
    return mid.select(rounded(slope, "slope"), F.round(F.col("my") - slope * F.col("mx"), 4).alias("intercept"), rounded(value[low], "lo_slope"), rounded(value[high], "hi_slope"))


def _slope_bits(met: DataFrame, prefixes: list[int], shift: int) -> dict[tuple[int, int], int]:
    """Numbers of slopes by (prefix, next 16 bits) of those whose bits above begin with one of ``prefixes``; the bits are in the order of the numbers."""
    import numpy as np
    import pandas as pd

    def count(key, pdf):
        a, b = (pdf[pdf["own"] == k] for k in key)
        dx = b["x"].to_numpy() - a["x"].to_numpy()[:, None]
        used = (dx != 0) if key[0] != key[1] else np.triu(dx != 0, 1)
        slopes = (b["y"].to_numpy() - a["y"].to_numpy()[:, None])[used] / dx[used] + 0.0
        bits = slopes.view(np.uint64)
        bits = np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))
        out = []
        for prefix in prefixes:
            mine = bits if shift == 48 else bits[bits >> np.uint64(shift + 16) == np.uint64(prefix)]
            n = np.bincount(((mine >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.int64))
            part = np.flatnonzero(n)
            out.append(pd.DataFrame({"prefix": np.full(len(part), prefix, np.int64), "part": part, "n": n[part]}))
        return pd.concat(out)

    found = met.groupBy("i", "j").applyInPandas(count, "prefix long, part long, n long").groupBy("prefix", "part").agg(F.sum("n").alias("n"))
    return {(r["prefix"], r["part"]): r["n"] for r in found.collect()}


def _number(bits: int) -> float:
    import struct

    return struct.unpack(">d", (bits ^ (1 << 63) if bits >> 63 else bits ^ ((1 << 64) - 1)).to_bytes(8, "big"))[0]
