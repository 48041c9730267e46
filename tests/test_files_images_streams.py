"""Files, pixel tables and streams on small hand-made inputs."""

from pyspark.sql import functions as F

from tidewave.operators import images
from tidewave.sources import files
from tidewave.streaming.rates import sliding_rates

SF = "/root/testdata/sf0.001"


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, [2, 3]), (2, [])], "cell long, near array<long>")
    files.write_csv(rows, f"{tmp_path}/a")
    back = files.read_csv(spark, {"a": f"{tmp_path}/a", "b": f"{tmp_path}/a"}, "cell long, near string").withColumn("near", files.json_list("near"))
    assert sorted(back.collect()) == [(1, [2, 3], "a"), (1, [2, 3], "b"), (2, [], "a"), (2, [], "b")]


def test_lists_and_frames(spark):
    rows = spark.createDataFrame([("[1, 2]",), ("3,4",), ("5",), ("x",), ("",), (None,)], "v string")
    assert [r[0] for r in rows.select(files.json_list("v")).collect()] == [[1, 2], [3, 4], [5], None, [], None]
    paths = spark.createDataFrame([("/d/a_t12.TIF",), ("/d/a.TIF",)], "path string")
    assert [r[0] for r in paths.select(files.frame_number("path")).collect()] == [12, None]


def test_datasets_are_replaced_one_by_one(spark, tmp_path):
    files.write_dataset(spark.createDataFrame([(1, "a"), (2, "b")], "v int, dataset string"), f"{tmp_path}/t")
    files.write_dataset(spark.createDataFrame([(3, "a")], "v int, dataset string"), f"{tmp_path}/t")
    assert sorted(r.v for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [2, 3]


def test_images(spark):
    px = spark.createDataFrame([("s", 0, y, x, 100 if y == x == 0 else 1) for y in range(4) for x in range(4)], "seq string, frame int, y int, x int, intensity int")
    fixed = {(r.y, r.x): r.intensity for r in images.repair_hot_pixels(px, 50).collect()}
    assert fixed[0, 0] == 103 / 4 and fixed[1, 1] == 1 and len(fixed) == 16
    assert sorted((r.y, r.x) for r in images.crop(px, 4, 4, 0.5).filter("intensity = 1").collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert images.clip(px, 9).agg(F.max("intensity")).first()[0] == 9
    mask = px.select("seq", "y", "x", ((F.col("y") == 1) & F.col("x").isin(1, 2)).cast("int").alias("label"))
    assert images.units(mask, 4, 4, 1, 5).collect() == [("s", 1, 2, 1, 1, True)]
    assert images.unit_traces(px, mask).collect() == [("s", 1, 0, 1.0)]
    moved = mask.withColumn("x", F.col("x") + 1)
    assert images.mask_overlap(mask, moved).collect() == [("s", 2, 2, 1, 0.5)]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    run = sliding_rates(stream).writeStream.format("memory").queryName("rates").outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(spark.table("rates").collect()) == sorted(sliding_rates(rows).collect())
