"""Sharding by longest-processing-time scheduling: groups that must stay together, largest first, to the least-loaded shard.

Only groups of equal size are interchangeable to the schedule, so it runs over size classes (size, number of groups): a
heap hands out the groups of a class one by one while the class is small, and whole rounds of it at once otherwise. The
driver reads one row per distinct group size. Sizes that differ sum to at least D*D/2 bytes for D classes, so D is at
most sqrt(2 * bytes of the corpus), whatever the number of rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SALTS, cut, spread_join

SCHEDULE = "size long, shard int, lo long, hi long"


def schedule(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """(size, shard, lo, hi): the groups numbered lo to hi-1 of a size go to the shard. Ties go to the smaller shard."""
    heap = [(0, s) for s in range(shards)]
    out = []
    for size, n in sorted(classes, reverse=True):
        given = [0] * shards
        left = n
        if left > 4 * shards and size > 0:
            # Whole rounds: the level that greedy filling certainly reaches, less one group a shard.
            low, high = 0, max(load for load, _ in heap) + size * (left // shards + 1)
            take = lambda level: sum(max(0, (level - load) // size) for load, _ in heap)
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if take(mid) <= left else (low, mid - 1)
            level = low - size
            filled = []
            for load, s in heap:
                k = max(0, (level - load) // size)
                given[s] += k
                left -= k
                filled.append((load + k * size, s))
            heap = filled
            heapq.heapify(heap)
        for _ in range(left):
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
            given[s] += 1
        at = 0
        for s in range(shards):
            if given[s]:
                out.append((size, s, at, at + given[s]))
                at += given[s]
    return out


def shard(docs: DataFrame, shards: int = 40, *, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """Puts each document in a shard; equal texts stay together; shard sizes come out near equal (law ``bytes``).

    Size: UTF-8 bytes of the text plus ``overhead``; a null text has none and forms a group with the empty texts. Null ids and repeated rows
    are rows like any other. ``slot`` numbers a shard's rows from 0 without gaps. An empty table gives an empty result. Other columns are not read.
    A group larger than an even share makes its shard that much larger: groups are never split.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("_group"),
    )
    rows = cut(rows)
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    groups = rows.groupBy("_group", spread.alias("_s")).agg(F.sum("size").alias("n")).groupBy("_group").agg(F.sum("n").alias("bytes"))
    groups = groups.withColumn("_bucket", F.pmod(F.xxhash64("_group"), F.lit(256)))
    by_bucket = Window.partitionBy("bytes", "_bucket").orderBy("_group")
    groups = cut(groups.withColumn("_nth", F.row_number().over(by_bucket) - 1))
    counts = groups.groupBy("bytes", "_bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bytes").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    classes = [(r["bytes"], r["n"]) for r in counts.groupBy("bytes").agg(F.sum("n").alias("n")).toLocalIterator()]
    plan = spark.createDataFrame(schedule(classes, shards), SCHEDULE)
    nth = groups.join(counts.drop("n"), ["bytes", "_bucket"]).withColumn("_nth", F.col("_nth") + F.col("_before"))
    placed = nth.join(plan, (nth["bytes"] == plan["size"]) & (F.col("_nth") >= F.col("lo")) & (F.col("_nth") < F.col("hi"))).select("_group", "shard")
    out = cut(spread_join(rows, placed, "_group", "doc_id").withColumn("_part", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1024))))
    lanes = out.groupBy("shard", "_part").agg(F.count("*").alias("n"))
    lead = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    lanes = lanes.select("shard", "_part", F.coalesce(F.sum("n").over(lead), F.lit(0)).alias("_lead"))
    inside = Window.partitionBy("shard", "_part").orderBy("doc_id", "_group")
    out = out.withColumn("_slot", F.row_number().over(inside) - 1).join(lanes, ["shard", "_part"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_slot") + F.col("_lead")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
