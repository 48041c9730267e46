"""Streams in three micro-batches, rows out of order, against the batch forms; state is freed behind the watermark."""

import pytest
from pyspark.sql import functions as F

from tidewave.operators import joins
from tidewave.sources.tables import neighbours, peaks
from tidewave.streaming.links import linked_causes
from tidewave.streaming.windows import spill_windows

SF = "/root/testdata/sf0.001"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def stream(spark, tmp_path):
    """Peaks by time in three files; every tenth peak comes one file late, if it is at most 20 hours before the next file's first peak."""
    hours = (F.col("frame") * 3600).cast("long")
    p = peaks(spark, SF).withColumn("at", F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp")) + hours))
    third = F.least(F.floor(F.col("frame") / 240), F.lit(2))
    moved = (F.col("event_id") % 10 == 0) & (F.col("frame") % 240 >= 220) & (third < 2)
    filed = p.withColumn("file", third + moved.cast("int"))
    last = filed.agg(F.max("at").alias("at")).select(F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("cell"), F.lit("end").alias("dataset"), (F.col("at") + F.expr("INTERVAL 400 HOURS")).alias("at"), F.lit(0).cast("long").alias("dur"))
    for i in range(3):
        filed.filter(F.col("file") == i).select("event_id", "cell", "dataset", "at", "dur").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    for i in (3, 4):
        last.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    assert filed.filter(moved).count() > 0

    def run(build):
        old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
        try:
            source = spark.readStream.schema("event_id long, cell long, dataset string, at timestamp, dur long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
            query = build(source).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
            query.awaitTermination()
            return spark.read.parquet(f"{tmp_path}/out"), query.recentProgress
        finally:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)

    return p, run


def test_spilled_windows(stream):
    p, run = stream
    out, progress = run(lambda s: spill_windows(s, hours=30, late="60 hours"))
    want = {tuple(r) for r in spill_windows(p, hours=30).collect()}
    got = [tuple(r) for r in out.filter("dataset <> 'end'").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    slots = p.groupBy("dataset", F.floor(F.unix_seconds("at") / 108_000).alias("slot")).count()
    assert {(r.dataset, r.slot): r["count"] for r in slots.collect()} == {(r.dataset, int(r.start.timestamp()) // 108_000): r.own for r in spill_windows(p).filter("own > 0").collect()}
    assert len([x for x in progress if x.numInputRows]) >= 4
    assert max(x.stateOperators[0].numRowsTotal for x in progress) < len(want) / 2


def test_linked_causes(spark, stream):
    p, run = stream
    edges = neighbours(p.select("cell").distinct())
    table = spark.createDataFrame(edges.collect(), "cell long, neighbour long")
    out, progress = run(lambda s: linked_causes(s, table, 15))
    want = {(r.event_id, r.cell, r.dataset, r.cause_id, r.cause_cell, r.lag) for r in joins.farthest_back(p, edges, 15).collect()}
    got = [(r.event_id, r.cell, r.dataset, r.cause_id, r.cause_cell, r.lag) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    held = [x.stateOperators[0].numRowsTotal for x in progress]
    assert held[-1] < max(held) / 5, held
