"""Tumbling windows of peaks with spill-over, on a table or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spill_windows(peaks: DataFrame, *, hours: int = 30, late: str = "60 hours") -> DataFrame:
    """(dataset, start, own, spilled): peaks that begin in each window, and peaks that end behind it and so are in the next one, too.

    ``peaks`` has dataset, at (timestamp) and dur (hours). Windows are counted from 1970. On a stream a window is given once, when the watermark
    has passed its end; the watermark trails the latest window any peak was put in by ``late``, so ``late`` is one window (a spilled peak
    runs ahead) and the delay rows may have. State holds open windows only.
    """
    width = hours * 3600
    second = F.unix_seconds(F.col("at").cast("timestamp"))
    slot = F.floor(second / width)
    behind = F.floor(second / 3600) + F.col("dur") >= (slot + 1) * hours
    kinds = F.array(F.struct(slot.alias("slot"), F.lit(0).alias("spilled")), F.when(behind, F.struct((slot + 1).alias("slot"), F.lit(1).alias("spilled"))))
    rows = peaks.select("dataset", F.explode(F.array_compact(kinds)).alias("s")).select("dataset", F.timestamp_seconds(F.col("s.slot") * width).alias("_at"), "s.spilled")
    if rows.isStreaming:
        rows = rows.withWatermark("_at", late)
    # Windows begin where slots do: 1970 began on a whole second, so the window of a slot's start is the slot.
    counted = rows.groupBy("dataset", F.window("_at", f"{hours} hours").alias("w")).agg(F.count_if(F.col("spilled") == 0).alias("own"), F.sum("spilled").alias("spilled"))
    return counted.select("dataset", F.col("w.start").alias("start"), "own", "spilled")
