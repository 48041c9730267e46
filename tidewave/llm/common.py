"""Shared plumbing of the training-data operators: table reads, lineage cuts, free column names and graph components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BENCHMARK, DOCUMENTS, EMBEDDINGS, LABELS, PAGES = "benchmark", "documents", "embeddings", "labels", "pages"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of the input folder, by Spark's own reader: the folder may be in a store only Spark can open."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Only a local session, which has one machine, may do without one."""
    named = spark.sparkContext._jsc.sc().getCheckpointDir()
    path = named.get() if named.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tidewave-")
    if not named.isDefined():
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return path


def cut(df: DataFrame, **options: str) -> DataFrame:
    """``df`` as a table written to the shared folder: lost executors then cost a read, not a recomputation. Columns not read cost nothing."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables of ``cut`` that nothing will read again."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free_name(columns: list[str], base: str) -> str:
    """``base``, with underscores in front until no column has that name, whatever the case of its letters."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the new column ``name``, a number that tells rows apart and is the same whenever it is computed.

    Rows read from files come in the same order as long as files are split alike, so the number of splits, which else follows the
    executors alive, is fixed for the session. Behind a shuffle rows come in any order, so such rows are cut first.
    """
    spark, pinned = df.sparkSession, "spark.sql.files.minPartitionNum"
    if spark.conf.get(pinned, None) is None:
        spark.conf.set(pinned, spark.sparkContext.defaultParallelism)
    plan = df._jdf.queryExecution().sparkPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
    out = df.withColumn(name, F.monotonically_increasing_id())
    return cut(out) if any(x in plan for x in ("Exchange", "Map", "Sample", "ExistingRDD", "Arrow")) else out


#: The most bytes a side of a join may take to be broadcast; a larger side is shuffled.
BROADCAST_BYTES = 16 << 20


def sized(df: DataFrame, size) -> DataFrame:
    """``df``, cut, and marked for broadcast only if ``size`` (estimated bytes of a row, a column) sums to ``BROADCAST_BYTES`` or less."""
    df = cut(df)
    total = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


SALTS = 32


def spread_join(rows: DataFrame, table: DataFrame, key: str, id_col: str) -> DataFrame:
    """Left join of ``rows`` with ``table``, which has one row per ``key``, where one key may own a third of all rows.

    The table's row of a key is copied once for each salt the key's rows have (``SALTS`` at most), never once a row.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(SALTS)))
    keys = salted.select(key, "_salt").distinct()
    return salted.join(keys.join(table, key), [key, "_salt"], "left").drop("_salt")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label): the least ``rank`` (ties: node) reachable over ``links(a, b)``, by minimum labels and pointer jumps.

    ``nodes`` has (node, rank), ``rank`` not null. Labels of more distant nodes double their reach every round. Each round is cut.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    linked = both.select(F.col("a").alias("node")).distinct()
    labels = cut(nodes.join(linked, "node").select("node", F.struct("rank", "node").alias("label")))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(seen, "node").select("node", F.least("label", "near").alias("new"), "label")
        roots = labels.select(F.col("node").alias("root"), F.col("label").alias("jump"))
        step = step.withColumn("root", F.col("new.node")).join(roots, "root").select("node", F.least("new", "jump").alias("label"), (F.least("new", "jump") != F.col("label")).alias("moved"))
        step = cut(step)
        release(labels)
        moved = step.filter("moved").limit(1).count()
        labels = step.select("node", "label")
        if not moved:
            release(both)
            return labels.select("node", F.col("label.rank").alias("label"))


#: Rows of one batch sent to a Python worker: texts may be long, and a worker holds a batch several times over.
BATCH = 1024


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session sends batches of ``BATCH`` rows unless it was told a size of its own."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, str(BATCH))
    return df


def tidy() -> None:
    """Give freed memory back to the system at the end of a task: workers live on, and idle ones count as much as busy ones."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the C library that has it
        pass


def slot_counts(docs: DataFrame, batch_counts, slots: int):
    """Broadcast of counts by slot (int32, ``slots`` of them, a power of two), summed over all rows of ``docs``.

    ``batch_counts(batches, total)`` adds what the batches of a task hold to ``total``. A task sends its counts as blocks of numbers.
    """
    size = min(slots, 1 << 14)

    def count(batches):
        total = np.zeros(slots, np.int64)
        batch_counts(batches, total)
        blocks = np.minimum(total, np.iinfo(np.int32).max).astype(np.int32).reshape(-1, size)
        at = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([blocks[i].tobytes() for i in at], pa.binary())], names=["block", "counts"])
        del total, blocks
        tidy()

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, counts in zip(batch.column("block").to_pylist(), batch.column("counts")):
                sums[at] = sums.get(at, 0) + np.frombuffer(counts.as_buffer(), np.int32).astype(np.int64)
        held = [np.minimum(x, np.iinfo(np.int32).max).astype(np.int32).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(held, pa.binary())], names=["block", "counts"])

    schema, parts = "block int, counts binary", min(slots // size, shuffle_partitions(docs.sparkSession))
    got = small_batches(docs).mapInArrow(count, schema).repartition(parts, "block").mapInArrow(add, schema).collect()
    table = np.zeros((slots // size, size), np.int32)
    for r in got:
        table[r["block"]] = np.frombuffer(r["counts"], np.int32)
    return docs.sparkSession.sparkContext.broadcast(table.ravel())
