"""Figures of events from their members (event, id, cell, frame, x, y), their links and their origin (event, o_cell, ox, oy, o_frame)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.operators import graph


def cells_of(members: DataFrame) -> DataFrame:
    return members.groupBy("event", "cell").agg(F.first("x").alias("x"), F.first("y").alias("y"))


def growth(members: DataFrame) -> DataFrame:
    """(event, growth_mean, growth_std, half, half_rate): members reached at each frame since the onset; frames to half of them; the slope
    within two frames of that, in hundredths of the members a frame."""
    spine = members.groupBy("event").agg(F.min("frame").alias("a"), F.max("frame").alias("b")).select("event", "a", F.explode(F.sequence("a", "b")).alias("frame"))
    n = members.groupBy("event", "frame").agg(F.count("*").alias("n"))
    w = Window.partitionBy("event")
    reached = spine.join(n, ["event", "frame"], "left").select("event", (F.col("frame") - F.col("a")).alias("i"), F.sum(F.coalesce("n", F.lit(0))).over(w.orderBy("frame")).alias("y"))
    marked = reached.withColumn("total", F.max("y").over(w)).withColumn("half", F.min(F.when(F.col("y") >= F.col("total") / 2, F.col("i"))).over(w))
    near = F.abs(F.col("i") - F.col("half")) <= 2
    slope = F.regr_slope(F.when(near, F.col("y")), F.when(near, F.col("i")))
    return marked.groupBy("event").agg(F.avg("y").alias("growth_mean"), F.stddev_pop("y").alias("growth_std"), F.first("half").alias("half"), (100 * slope / F.first("total")).alias("half_rate"))


def direction(members: DataFrame, links: DataFrame, origin: DataFrame) -> DataFrame:
    """(event, vx, vy): unit vector from the origin to the mean place of the other cells; zero if that lies nearer than half the mean place of what the origin caused."""
    others = cells_of(members).join(origin.select("event", "o_cell"), "event").filter("cell <> o_cell").groupBy("event").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    caused = links.join(origin.select("event", F.col("o_cell").alias("cause_cell")), ["event", "cause_cell"]).select("event", F.col("event_id").alias("id"))
    near = members.join(caused, ["event", "id"]).groupBy("event").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    dx, dy = F.col("mx") - F.col("ox"), F.col("my") - F.col("oy")
    way = origin.join(others, "event").join(near, "event").withColumns({"dx": dx, "dy": dy, "size": F.sqrt(dx**2 + dy**2), "bar": F.sqrt((F.col("cx") - F.col("ox")) ** 2 + (F.col("cy") - F.col("oy")) ** 2)})
    good = (F.col("size") > 0) & (F.col("size") >= 0.5 * F.col("bar"))
    return way.select("event", F.when(good, F.col("dx") / F.col("size")).otherwise(0.0).alias("vx"), F.when(good, F.col("dy") / F.col("size")).otherwise(0.0).alias("vy"))


def shape(members: DataFrame, origin: DataFrame, spread: DataFrame) -> DataFrame:
    """(event, elongation, radiality, compactness): axes of the cells' covariance (100 at most, 1 for under three cells, null on a line), one minus
    the origin's distance from their mean place by the greatest, and mean distance of two cells by that of the population (``spread(pop)``, one row)."""
    c = graph.cut(cells_of(members))
    mean = c.groupBy("event").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"))
    far = c.join(mean.select("event", "mx", "my"), "event").groupBy("event").agg(F.max(F.sqrt((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2)).alias("r"))
    h, g = (F.col("xx") + F.col("yy")) / 2, F.sqrt(((F.col("xx") - F.col("yy")) / 2) ** 2 + F.col("xy") ** 2)
    long = F.when(F.col("n") < 3, 1.0).when(h - g > 1e-9 * h, F.least(F.sqrt((h + g) / (h - g)), F.lit(100.0)))
    off = F.sqrt((F.col("ox") - F.col("mx")) ** 2 + (F.col("oy") - F.col("my")) ** 2)
    radial = F.when((F.col("n") < 3) | (F.col("r") == 0), 0.0).otherwise(1 - off / F.col("r"))
    b = c.select("event", F.col("cell").alias("other"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    own = c.join(b, "event").filter("cell < other").groupBy("event").agg(F.avg(F.sqrt((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2)).alias("own"))
    out = mean.join(far, "event").join(origin, "event").join(own, "event", "left").crossJoin(F.broadcast(spread))
    return out.select("event", long.alias("elongation"), radial.alias("radiality"), (F.col("own") / F.col("pop")).alias("compactness"))


def pace(links: DataFrame) -> DataFrame:
    """(event, com_speed, com_speed_std, com_time, com_time_std) of links with ``distance``; a link within one frame counts as one frame's way."""
    lag = F.col("frame") - F.col("cause_frame")
    speed = F.col("distance") / F.greatest(lag, F.lit(1))
    return links.groupBy("event").agg(F.avg(speed).alias("com_speed"), F.stddev_pop(speed).alias("com_speed_std"), F.avg(lag).alias("com_time"), F.stddev_pop(lag).alias("com_time_std"))


def phases(links: DataFrame) -> DataFrame:
    """``links`` with time_phase and recruitment_phase: the share of the event's time, and of the cells reached by links, that lies before a link."""
    w = Window.partitionBy("event")
    first = links.groupBy("event", "cell").agg(F.min("frame").alias("frame")).groupBy("event", "frame").agg(F.count("*").alias("n"))
    steps = links.select("event", "frame").distinct().join(first, ["event", "frame"], "left")
    steps = steps.withColumns({"before": F.coalesce(F.sum("n").over(w.orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "total": F.sum("n").over(w)}).drop("n")
    span = links.groupBy("event").agg(F.min("cause_frame").alias("t0"), F.max("frame").alias("t1"))
    time = F.when(F.col("t1") > F.col("t0"), (F.col("frame") - F.col("t0")) / (F.col("t1") - F.col("t0"))).otherwise(0.0)
    recruit = F.when(F.col("total") > 1, F.col("before") / (F.col("total") - 1)).otherwise(0.0)
    return links.join(steps, ["event", "frame"]).join(span, "event").withColumns({"time_phase": time, "recruitment_phase": recruit}).drop("before", "total", "t0", "t1")


def wave_axis(members: DataFrame, bins: int = 6, spread: float = 3.0) -> DataFrame:
    """(event, vx, vy, speed) of waves: the main axis of the middles of the inner time bins, turned the way the wave went, and its net way by time.

    A bin's middle is the mean of its cells no further from their median place than the median distance plus ``spread`` median deviations;
    an empty bin lies at (0, 0). A wave that moved less than a quarter of its extent has no axis and no speed.
    """
    span = members.groupBy("event").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    edge = lambda i: F.col("a") + F.floor(i * (F.col("b") - F.col("a") + 1) / bins)
    grid = span.withColumn("i", F.explode(F.array(*map(F.lit, range(bins))))).withColumns({"lo": edge(F.col("i")), "hi": F.when(F.col("i") == bins - 1, F.col("b")).otherwise(edge(F.col("i") + 1) - 1)})
    grid = graph.cut(grid.select("event", "i", "lo", "hi"))
    held = members.join(grid, "event").filter(F.col("frame").between(F.col("lo"), F.col("hi"))).select("event", "i", "cell", "x", "y").distinct()
    held = graph.cut(held)
    middle = held.groupBy("event", "i").agg(F.median("x").alias("mx"), F.median("y").alias("my"))
    off = held.join(middle, ["event", "i"]).withColumn("r", F.sqrt((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2))
    near = off.groupBy("event", "i").agg(F.median("r").alias("m"))
    bar = off.join(near, ["event", "i"]).groupBy("event", "i").agg((F.first("m") + spread * F.median(F.abs(F.col("r") - F.col("m")))).alias("bar"))
    com = off.join(bar, ["event", "i"]).filter(F.col("r") <= F.col("bar") + 1e-9).groupBy("event", "i").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    points = grid.join(com, ["event", "i"], "left").select("event", "i", ((F.col("lo") + F.col("hi")) / 2).alias("t"), (F.col("hi") >= F.col("lo")).alias("some"), F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
    at = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
    timed = lambda i: F.max(F.when((F.col("i") == i) & F.col("some"), F.col("t")))
    way = points.filter(F.col("i").between(1, bins - 2)).groupBy("event").agg(
        F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"), (at("x", bins - 2) - at("x", 1)).alias("dx"), (at("y", bins - 2) - at("y", 1)).alias("dy"), (timed(bins - 2) - timed(1)).alias("dt")
    )
    a = held.select("event", "cell", "x", "y").distinct()
    b = a.select("event", F.col("x").alias("x2"), F.col("y").alias("y2"))
    wide = a.join(b, "event").groupBy("event").agg(F.max(F.sqrt((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2)).alias("extent"))
    turn = 0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy"))
    net = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)
    moved = (F.col("extent") > 0) & (net >= 0.25 * F.col("extent"))
    sign = F.when(F.cos(turn) * F.col("dx") + F.sin(turn) * F.col("dy") < 0, -1.0).otherwise(1.0)
    return way.join(wide, "event").select("event", F.when(moved, sign * F.cos(turn)).otherwise(0.0).alias("vx"), F.when(moved, sign * F.sin(turn)).otherwise(0.0).alias("vy"), F.when(moved & (F.col("dt") > 0), net / F.col("dt")).otherwise(0.0).alias("speed"))
