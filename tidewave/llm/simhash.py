"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprints of 64 bits that differ in at most d bits share at least 8-d of their 8 positional bytes. The index posts a
fingerprint under each choice of 8-d positions with the bytes there, so any pair that reaches the guaranteed minimum of
shared positional bytes meets, and no other pair does. Pairs that meet are tallied, then verified bit by bit. Equal
fingerprints are one node of the link graph, so copies never make pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import SALTS, components, cut, spread_join

_BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text; 0 for a text without words."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    total, n = np.zeros(64, np.int64), max(1, len(words) - width + 1)
    for at in range(0, n, _BLOCK):
        hashes = np.array([h(b" ".join(words[i : i + width]), 42) for i in range(at, min(n, at + _BLOCK))], ">u8")
        total += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprint_column(width: int):
    @F.pandas_udf(LongType())
    def column(text: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in text], dtype=np.uint64).astype(np.int64)

    return column


def near_pairs(prints: DataFrame, distance: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of distinct 64-bit values ``node`` at ``distance`` or fewer differing bits."""
    shared = 8 - distance
    masks = []
    for places in combinations(range(8), shared):
        m = sum(0xFF << (8 * p) for p in places)
        masks.append(m - (1 << 64) if m >> 63 else m)
    posting = F.array(*[F.struct(F.lit(i).alias("places"), F.col("node").bitwiseAND(F.lit(m)).alias("bytes")) for i, m in enumerate(masks)])
    index = prints.select("node", F.explode(posting).alias("p")).select(F.col("node"), "p.places", "p.bytes")
    lone = index.groupBy("places", "bytes").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    index = cut(index.join(lone, ["places", "bytes"], "left_semi"))
    left, right = index.withColumnRenamed("node", "a"), index.withColumnRenamed("node", "b")
    diff = F.col("a").bitwiseXOR(F.col("b"))
    tally = sum(F.when(diff.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) == 0, 1).otherwise(0) for m in (0xFF << (8 * p) for p in range(8)))
    met = left.join(right, ["places", "bytes"]).filter("a < b")
    return met.filter((tally >= shared) & (F.bit_count(diff) <= distance)).select("a", "b").distinct()


def simhash_groups(docs: DataFrame, *, width: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, fingerprint, component_id (least doc_id reachable over links, itself included).

    Null and blank texts have fingerprint zero and are linked like any other. A null id never names a component unless all its ids are
    null. Repeated rows stay. Ties cannot arise: the least id is unique. An empty table gives an empty result; other columns are not read.
    """
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(width)(F.col(text_col)).alias("node")))
    # Null ids come last, whatever the largest id is.
    ranked = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))
    salted = rows.groupBy("node", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("s")).agg(F.min(ranked).alias("rank"))
    nodes = cut(salted.groupBy("node").agg(F.min("rank").alias("rank")))
    found = components(nodes, near_pairs(nodes, distance))
    table = nodes.join(found, "node", "left").select("node", F.coalesce("label", "rank")["id"].alias("component_id"))
    out = spread_join(rows, table, "node", "doc_id")
    return out.select("doc_id", F.lpad(F.lower(F.hex("node")), 16, "0").alias("fingerprint"), "component_id")
