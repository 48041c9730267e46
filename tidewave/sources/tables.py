"""Table reads, and peaks as the events table carries them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One peak per event: hourly frame of the peak, its cell, dataset, height and duration in frames (0 to 9)."""
    hour = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)").cast("long")
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("cell"), F.col("event_type").alias("dataset"), hour.alias("frame"), F.col("value").alias("height"), F.floor(k / 10).cast("long").alias("dur")
    )


def neighbours(cells: DataFrame, columns: int = 15) -> DataFrame:
    """Directed edges (cell, neighbour) of the grid the cells lie on: Chebyshev distance 1. Each cell makes eight candidates; no pair join."""
    x, y = F.col("cell") % columns, F.floor(F.col("cell") / columns)
    steps = F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j])
    near = cells.select("cell", x.alias("x"), y.alias("y"), F.explode(steps).alias("s"))
    near = near.filter((F.col("x") + F.col("s.dx")).between(0, columns - 1) & (F.col("y") + F.col("s.dy") >= 0))
    near = near.select("cell", ((F.col("y") + F.col("s.dy")) * columns + F.col("x") + F.col("s.dx")).cast("long").alias("neighbour"))
    return near.join(cells.select(F.col("cell").alias("neighbour")), "neighbour", "left_semi").select("cell", "neighbour")


def last_frame(rows: DataFrame) -> DataFrame:
    """One row with the last frame a peak of ``rows`` is in: the end of the recording."""
    return rows.agg(F.max("frame").alias("last"))
