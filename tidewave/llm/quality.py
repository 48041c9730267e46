"""Quality selection by importance resampling.

Two bags of hashed word n-grams are counted, one over the target (labelled good) documents and one over all documents. A
document's log weight is the log ratio of its probabilities under both; Gumbel top-k draws k documents without
replacement in proportion to the weights.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

BUCKETS = 1 << 16
SMOOTH = 1.0
#: The target model is fitted on this many labelled rows at most, those with the least hash of their id. Their ids (8 bytes each) are sent
#: to all tasks, so that no text is shuffled. The raw model is counted over all rows, and all rows are weighed and drawn from.
TARGET_ROWS = 25_000


class _Hashes(dict):
    """Hashes of words met by a worker; bounded, as words beyond are hashed anew."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


_HASHES = _Hashes()


def features(text: str | None) -> np.ndarray:
    """Buckets of the word unigrams and bigrams of the whole text, repeats included."""
    words = (text or "").lower().encode("utf-8", "replace").split()
    one = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]) * np.uint64(0xD6E8FEB86659FD93)
    return (np.concatenate((one, two ^ (two >> np.uint64(32)))) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _counts(rows: DataFrame, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-grams by bucket of the rows whose id is in ``targets`` (sorted) and of all rows: 2 x ``BUCKETS`` numbers whatever the number of rows."""
    sent = rows.sparkSession.sparkContext.broadcast(targets)

    def count(batches):
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            ids = batch.column("doc_id")
            good = np.isin(ids.fill_null(0).to_numpy(zero_copy_only=False), sent.value) & ids.is_valid().to_numpy(zero_copy_only=False)
            for t, is_good in zip(batch.column("text"), good):
                n = np.bincount(features(t.as_py()), minlength=BUCKETS)
                total[1] += n
                if is_good:
                    total[0] += n
        which, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[which, bucket])], names=["which", "bucket", "n"])

    got = small_batches(rows.select("doc_id", "text")).mapInArrow(count, "which int, bucket int, n long").groupBy("which", "bucket").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((2, BUCKETS))
    out[got["which"].to_numpy(np.int64), got["bucket"].to_numpy(np.int64)] = got["n"]
    return out[0], out[1]


def log_ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of each bucket's probability under the target counts ``a`` over that under the raw counts ``b``."""
    share = b / max(1.0, b.sum())
    # Buckets with little evidence lean to the raw model, so a ratio far from 1 needs counts.
    smooth = (a + SMOOTH * len(a) * share + 1e-9) / (a.sum() + SMOOTH * len(a) + 1e-9 * len(a))
    return np.log(smooth) - np.log((b + 1e-9) / (b.sum() + 1e-9 * len(b)))


def top_k(rows: DataFrame, key: str, tie: str, k: int, bins: int = 4096) -> DataFrame:
    """``rows`` with ``selected`` for exactly the k largest keys (ties: smaller ``tie``). The cut is narrowed by histograms, not by a sort of all rows."""
    ends = rows.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("n")).first()
    if k >= ends["n"]:
        return rows.withColumn("selected", F.lit(True))
    if k <= 0:
        return rows.withColumn("selected", F.lit(False))
    lo, hi, left = ends["lo"], ends["hi"], k
    while True:
        width = (hi - lo) / bins
        inside = rows.filter((F.col(key) >= lo) & (F.col(key) <= hi))
        if width <= 0 or lo + width <= lo or inside.count() <= 10_000:
            break
        bin_of = F.least(F.floor((F.col(key) - lo) / width), F.lit(bins - 1))
        sizes = {r["b"]: r["n"] for r in inside.groupBy(bin_of.alias("b")).agg(F.count("*").alias("n")).collect()}
        for b in sorted(sizes, reverse=True):
            if sizes[b] >= left:
                break
            left -= sizes[b]
        edge = inside.filter(bin_of == b).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
        if (edge["lo"], edge["hi"]) == (lo, hi):
            break
        lo, hi = edge["lo"], edge["hi"]
    last = inside.orderBy(F.desc(key), tie).limit(left).select(F.col(key).alias("_k"), F.col(tie).alias("_t")).orderBy("_k", F.desc("_t")).first()
    return rows.withColumn("selected", (F.col(key) > last["_k"]) | ((F.col(key) == last["_k"]) & (F.col(tie) <= last["_t"])))


def resample(
    docs: DataFrame, labels: DataFrame, *, share: float | None = None, seed: int = 0, target_rows: int = TARGET_ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: doc_id, log_weight, gumbel_key, selected.

    The target is documents labelled quality 1 and not toxic, ``target_rows`` of them at most, by least hash of their id. ``share`` of the
    rows is drawn; by default the share of target rows among all labelled ones. Null and empty texts have weight 0 (both models give 1).
    Noise comes from (seed, id, text), so reruns agree; equal keys go by a row hash. Repeated rows tie and share their fate. Texts of any
    length are read whole; other columns are not read, whatever their names. No labels or no rows: share 1, all are selected.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    good = labels.groupBy("doc_id").agg(F.min((F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
    figures = good.agg(F.count("*").alias("n"), F.count_if("good").alias("good")).first()
    if share is None:
        share = figures["good"] / figures["n"] if figures["good"] else 1.0
    some = good.filter("good AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"))
    targets = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows).toPandas()["doc_id"].to_numpy(np.int64)
    held = docs.sparkSession.sparkContext.broadcast(log_ratio(*_counts(rows, np.sort(targets))))

    @F.pandas_udf("double")
    def weight(text: pd.Series) -> pd.Series:
        return pd.Series([float(held.value[features(t)].sum()) for t in text], dtype=np.float64)

    noise = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    out = rows.select("doc_id", weight("text").alias("log_weight"), noise.alias("u"), F.xxhash64("text", "doc_id").alias("_tie"))
    out = cut(out.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log("u"))).drop("u"))
    return top_k(out, "gumbel_key", "_tie", round(share * out.count())).drop("_tie")
