"""Causes of peaks on a stream: keyed state with timers gives each peak the neighbour's peak farthest back, once the watermark lets nothing earlier come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR = 3_600_000
OUT = "event_id long, cell long, dataset string, frame long, cause_id long, cause_cell long, lag long"


class Causes(StatefulProcessor):
    """State of one cell of a dataset: the first peak of its neighbours by frame, and its own peaks that wait for the watermark."""

    def __init__(self, reach: int):
        self.reach = reach

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.causes = handle.getMapState("causes", "frame long", "event_id long, cell long")
        self.waiting = handle.getMapState("waiting", "event_id long", "frame long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = set()
        for pdf in rows:
            for event_id, frame, sender, own in zip(pdf["event_id"], pdf["frame"], pdf["sender"], pdf["own"]):
                event_id, frame, sender = int(event_id), int(frame), int(sender)
                if own:
                    self.waiting.updateValue((event_id,), (frame,))
                    frames.add(frame)
                else:
                    if not self.causes.containsKey((frame,)) or event_id < self.causes.getValue((frame,))[0]:
                        self.causes.updateValue((frame,), (event_id, sender))
                    frames.add(frame + self.reach)
        for frame in frames:
            self.handle.registerTimer(frame * HOUR)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """What was before the watermark's hour is complete: peaks up to it are answered, peaks out of anyone's reach forgotten."""
        done = timerValues.getCurrentWatermarkInMs() // HOUR
        held = sorted((k[0], tuple(v)) for k, v in self.causes.iterator())
        out = []
        for (event_id,), (frame,) in list(self.waiting.iterator()):
            if frame > done:
                continue
            cause = next(((f, i, c) for f, (i, c) in held if frame - self.reach <= f < frame), None)
            if cause:
                out.append((event_id, int(key[1]), key[0], frame, cause[1], cause[2], frame - cause[0]))
            self.waiting.removeKey((event_id,))
        for frame, _ in held:
            if frame + self.reach < done:
                self.causes.removeKey((frame,))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def linked_causes(peaks: DataFrame, edges: DataFrame, reach: int, late: str = "24 hours") -> DataFrame:
    """``farthest_back`` on a stream of peaks (event_id, cell, dataset, at): hours of ``at`` since 1970 are the frames.

    Each peak goes to its own cell and, as a possible cause, to its neighbours of the table ``edges(cell, neighbour)``. A peak is answered
    when the watermark, ``late`` behind the latest peak, reaches its hour; rows later than that are dropped. State holds the peaks of the
    last ``reach`` hours and of the delay. The session must keep state in RocksDB, as all queries of this kind.
    """
    frame = F.floor(F.unix_seconds(F.col("at").cast("timestamp")) / 3600)
    timed = peaks.select("event_id", "cell", "dataset", frame.alias("frame"), F.col("at").cast("timestamp").alias("at")).withWatermark("at", late)
    to = edges.groupBy("cell").agg(F.collect_set("neighbour").alias("to"))
    sent = timed.join(to, "cell", "left")
    ends = F.concat(F.array(F.struct(F.col("cell").alias("cell"), F.lit(True).alias("own"))), F.transform(F.coalesce("to", F.array().cast("array<long>")), lambda n: F.struct(n.alias("cell"), F.lit(False).alias("own"))))
    rows = sent.select("event_id", "frame", "at", "dataset", F.col("cell").alias("sender"), F.explode(ends).alias("s")).select("event_id", "frame", "at", "dataset", "sender", "s.cell", "s.own")
    return rows.groupBy("dataset", "cell").transformWithStateInPandas(Causes(reach), OUT, "Append", "EventTime")
