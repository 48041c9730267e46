"""Near copies of documents by their word shingles: SimHash retrieval, completed by an exact set-similarity join.

A document is the set of its shingles, named by 64 bits; equal sets are one node. Candidates come from three sources, and every
one is verified on the whole texts before it links two nodes:

* the byte-position index of ``simhash`` over the SimHash of the shingles;
* min-wise signatures: each node meets the least node that shares a signature, so a group of near copies makes as many pairs as nodes;
* an exact join for what 64 bits and signatures miss. Shingles are ordered by rarity (counts in a fixed number of hashed slots, then
  the hash); two sets with Jaccard similarity t or more share one among their |x| - ceil(t|x|) + 1 rarest. Entries of one shingle
  whose nodes are all linked by then are left out; the others meet the least of them, then one by hash, and last each other, with a
  length and a positional filter.

Only components are wanted, so pairs that are linked already are never formed again, and none is lost.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, release, sized, slot_counts, tidy
from .simhash import near_pairs

JACCARD, WIDTH = 0.8, 5
SLOTS = 1 << 20
#: Min-wise signatures a set has, and the permutations joined in each.
SIGNATURES, JOINED = 4, 3
#: Differing bits up to which the byte-position index retrieves pairs.
DISTANCE = 2
_ODD = [(0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64) | 1 for k in range(SIGNATURES * JOINED)]


class _Hashes(dict):
    """Hashes of words met by a worker; bounded, as words beyond are hashed anew."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, 5)
        return found


_HASHES = _Hashes()


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text (ASCII lower case, split at ASCII white space); a shorter text is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(h))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def _fingerprint(h: np.ndarray) -> int:
    """SimHash of a set of hashes as a signed number; 0 for the empty set."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        total += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(h)).tobytes(), "big", signed=True)


def _order(docs: DataFrame, width: int):
    """Broadcast of shingle counts by slot."""

    def count(batches, total):
        for batch in batches:
            for text in batch.column("text"):
                slots = (shingle_hashes(text.as_py(), width) & np.uint64(SLOTS - 1)).astype(np.int64)
                if len(slots):
                    np.add.at(total, slots, 1)

    return slot_counts(docs.select("text"), count, SLOTS)


def _sets(docs: DataFrame, row: str, held, width: int, jaccard: float) -> DataFrame:
    """Per row its set's key (k1, k2), size n, SimHash, signatures and rarest shingles."""

    def parse(batches):
        for batch in batches:
            keys, signs, prefixes = [], [], []
            for text in batch.column("text"):
                h = shingle_hashes(text.as_py(), width)
                n = len(h)
                lead = n - int(np.ceil(jaccard * n - 1e-9)) + 1 if n else 0
                order = np.lexsort((h, held.value[(h & np.uint64(SLOTS - 1)).astype(np.int64)]))[:lead]
                again = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                again ^= again >> np.uint64(32)
                keys.append((int(h.sum().view(np.int64)), int(again.sum().view(np.int64)), n, _fingerprint(h)))
                mine = []
                for j in range(SIGNATURES if n else 0):
                    sign = 0
                    for k in range(JOINED):
                        sign = sign * _ODD[0] + int((again * np.uint64(_ODD[j * JOINED + k])).min())
                    mine.append((sign * _ODD[1] >> 20) % (1 << 56) * SIGNATURES + j)
                signs.append(mine)
                prefixes.append(h[order].view(np.int64))
            k1, k2, n, bits = (pa.array([k[i] for k in keys], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64())))
            columns = [batch.column("row"), k1, k2, n, bits, pa.array(signs, pa.list_(pa.int64())), pa.array(prefixes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "k1", "k2", "n", "bits", "signs", "prefix"])
        tidy()

    schema = "row long, k1 long, k2 long, n int, bits long, signs array<long>, prefix array<long>"
    return docs.select(F.col(row).alias("row"), "text").mapInArrow(parse, schema)


def _retrieved(nodes: DataFrame, jaccard: float) -> DataFrame:
    """Pairs (a, b), a < b, by the byte-position index of SimHash and by signatures, filtered by length."""
    prints = cut(nodes.groupBy("bits").agg(F.min("node").alias("least")))
    near = near_pairs(prints.select(F.col("bits").alias("node")), DISTANCE)
    a, b = (prints.select(F.col("bits").alias(q), F.col("least").alias(f"{q}_node")) for q in "ab")
    linked = near.join(a, "a").join(b, "b").select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))
    entries = nodes.select(F.explode(F.concat("signs", F.array(F.xxhash64("bits")))).alias("sign"), "node")
    least = entries.groupBy("sign").agg(F.min("node").alias("a"), F.max("node").alias("_most")).filter("a < _most").drop("_most")
    star = entries.join(least, "sign").filter("a < node").select("a", F.col("node").alias("b"))
    pairs = linked.union(star).distinct()
    sizes = nodes.select("node", "n")
    both = pairs.join(sizes.toDF("a", "a_n"), "a").join(sizes.toDF("b", "b_n"), "b")
    return cut(both.filter(F.least("a_n", "b_n") >= F.lit(jaccard) * F.greatest("a_n", "b_n") - 1e-9).select("a", "b"))


def _met(x: DataFrame, y: DataFrame, jaccard: float) -> DataFrame:
    """Distinct pairs (a, b), a < b, of entries of one shingle, not linked yet, that pass the length and positional filters."""
    x, y = (d.select(*[F.col(c).alias(f"{p}_{c}") for c in ("word", "node", "n", "at", "label")]) for p, d in (("x", x), ("y", y)))
    need = F.ceil(F.lit(jaccard / (1 + jaccard)) * (F.col("x_n") + F.col("y_n")) - 1e-9)
    reach = F.least("x_at", "y_at") + F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))
    near = F.least("x_n", "y_n") >= F.lit(jaccard) * F.greatest("x_n", "y_n") - 1e-9
    met = x.join(y, (F.col("x_word") == F.col("y_word")) & (F.col("x_label") != F.col("y_label")) & near & (reach >= need))
    return cut(met.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct())


def _verified(pairs: DataFrame, docs: DataFrame, row: str, width: int, jaccard: float) -> DataFrame:
    """The pairs whose sets reach the similarity. Texts of candidates are sent; a worker keeps the sets of the last few."""
    nodes = sized(pairs.select(F.explode(F.array("a", "b")).alias(row)).distinct(), F.lit(16))
    texts = cut(docs.select(row, "text").join(nodes, row, "left_semi"))
    a, b = (texts.select(F.col(row).alias(q), F.col("text").alias(f"{q}_text")) for q in "ab")

    def check(batches):
        held = lru_cache(maxsize=8)(lambda t: shingle_hashes(t, width))
        for batch in batches:
            fine = []
            for x, y in zip(batch.column("a_text"), batch.column("b_text")):
                x, y = held(x.as_py()), held(y.as_py())
                merged = np.concatenate((x, y))
                merged.sort()
                shared = int((merged[1:] == merged[:-1]).sum())
                fine.append(shared >= jaccard * (len(x) + len(y) - shared) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))
        held.cache_clear()
        tidy()

    out = cut(pairs.join(b, "b").join(a, "a").select("a", "b", "a_text", "b_text").mapInArrow(check, "a long, b long"))
    release(nodes, texts)
    return out


def later_copies(docs: DataFrame, row: str, *, width: int = WIDTH, jaccard: float = JACCARD, text_col: str = "text") -> DataFrame:
    """(row): the rows of ``docs`` that are not the first of their group of near copies, rows linked over pairs that reach ``jaccard``.

    Null and blank texts have the empty set and are one group. ``row`` names a column that tells rows apart and orders them. Repeated
    rows are copies. Texts of any length are read whole; other columns are not read. An empty table gives an empty result.
    """
    docs = docs.select(row, F.col(text_col).alias("text"))
    rows = cut(_sets(docs, row, _order(docs, width), width, jaccard))
    keys = cut(rows.groupBy("k1", "k2").agg(F.min("row").alias("node"), F.count("*").alias("copies")))
    nodes = cut(rows.join(keys.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "n", "bits", "signs", "prefix"))
    ranks = nodes.select("node", F.col("node").alias("rank"))
    met = _retrieved(nodes, jaccard)
    links = _verified(met, docs, row, width, jaccard)
    labels = cut(components(ranks, links))
    entries = nodes.filter("n > 0").select("node", "n", F.posexplode("prefix").alias("at", "word"))
    marked = entries.join(sized(labels.filter("label != node"), F.lit(24)), "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = marked.groupBy("word").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("word")
    entries = cut(marked.join(mixed, "word", "left_semi").drop("label"))
    for pivot in (F.col("node"), F.xxhash64("node", "word"), None):
        now = entries.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = now.groupBy("word").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("word")
        now = cut(now.join(mixed, "word", "left_semi"))
        if not now.limit(1).count():
            break
        other = now
        if pivot is not None:
            least = F.min(F.struct(pivot.alias("p"), "node", "n", "at", "label")).alias("s")
            other = now.groupBy("word").agg(least).select("word", "s.node", "s.n", "s.at", "s.label")
        found = _verified(_met(now, other, jaccard), docs, row, width, jaccard)
        links = cut(links.union(found))
        labels = cut(components(ranks, links))
        release(now)
    first = keys.select("k1", "k2", "node").join(labels, "node", "left").select("k1", "k2", F.coalesce("label", "node").alias("first"))
    out = cut(rows.select("k1", "k2", "row").join(first, ["k1", "k2"]).filter("row != first").select(F.col("row").alias(row)))
    release(rows, nodes, entries)
    return out
