"""Best-fit packing with certified bin counts.

Documents become token pieces. Pieces are dealt to partitions of bounded size and packed there by best-fit decreasing.
Dual feasible functions give a lower bound of each partition's bin count; a partition that reaches its bound is optimal
and done. Partitions with gaps give up the pieces of their bins that are not full; those are exchanged (dealt anew) and
packed again, until nothing is gained. Then the bins that are not full of all partitions are exchanged likewise. The bound
over all pieces, from the histogram of lengths (at most ``capacity`` rows), certifies the whole: who meets it is done.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, tidy

CAPACITY = 2048
#: Pieces in one partition of the packing; bounds the memory of a task.
PART = 40_000


#: Words whose ids a worker keeps, and the longest of them; others are encoded anew.
KEPT_WORDS, LONGEST_WORD = 150_000, 64
#: Fixed value: the pre-tokenizer of byte-level BPE files with ``use_regex``.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same for texts of ASCII and the letters of two more blocks, where plain classes of characters do.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
_PLAIN = re.compile(rf"[\t-\r -~{_LETTERS}]*+\Z").match
_PLAIN_WORDS = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\t-\r {_LETTERS}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+").findall


class Encoder(dict):
    """Ids of whole texts as the library gives them, little-endian unsigned 32-bit. As words never influence each other, the library
    encodes each distinct word once; added tokens inside texts are cut out first, as the library does."""

    def __init__(self, path: str):
        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        pre = spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        added = spec["added_tokens"]
        simple = not any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in added)
        #: Other kinds of files are left to the library, text by text.
        self.by_word = plain and simple
        self.words = regex.compile(WORD).findall
        self.added = {x["content"]: np.array([x["id"]], "<u4").tobytes() for x in added}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self._library(word)
        if len(word) <= LONGEST_WORD:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return self._library(text)
        if self.special is None or not any(x in text for x in self.added):
            return b"".join(map(self.__getitem__, _PLAIN_WORDS(text) if _PLAIN(text) else self.words(text)))
        return b"".join(self.added[part] if part in self.added else b"".join(map(self.__getitem__, self.words(part))) for part in self.special.split(text) if part)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces_of(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Token pieces of each document: its ids, then ``end_id``; only documents above ``capacity`` ids are cut. The first piece takes the rest."""
    end = np.array([end_id], "<u4").tobytes()

    def cut_up(batches):
        encode = encoder(vocabulary).encode
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                first = n % capacity or capacity
                cuts = [0, *range(first, n + 1, capacity)]
                out += [(doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            columns = zip(*out) if out else ((),) * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        tidy()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return small_batches(rows).mapInArrow(cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: dict[int, int], capacity: int) -> int:
    """Least number of bins any packing needs: the best of the dual feasible functions u(k) and f(eps)."""
    items = sorted(lengths.items())
    if not items:
        return 0
    size = np.array([s for s, _ in items], np.int64)
    count = np.array([n for _, n in items], np.int64)
    best = -(-int((size * count).sum()) // capacity)
    for eps in {int(s) for s in size if 2 * s <= capacity} | {0}:
        # f: sizes above capacity-eps count as whole, sizes below eps as nothing.
        f = np.where(size > capacity - eps, capacity, np.where(size < eps, 0, size))
        best = max(best, -(-int((f * count).sum()) // capacity))
    for k in range(1, 21):
        # u: (k+1)x whole stays, the rest is rounded down; scaled by k*capacity.
        whole = (k + 1) * size % capacity == 0
        u = np.where(whole, size * k, (k + 1) * size // capacity * capacity)
        best = max(best, -(-int((u * count).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each length, and the fill of each bin. Largest first, into the fullest bin that still takes it."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms = 0  # bit r: some bin has room r
    fill: list[int] = []
    for i in order.tolist():
        need = int(lengths[i])
        fits = rooms >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(fill), capacity
            fill.append(0)
        where[i], offset[i] = b, fill[b]
        fill[b] += need
        left = room - need
        if left:
            open_bins[left].append(b)
            rooms |= 1 << left
    return where, offset, fill


_COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long, gap long"


def _pack(items: DataFrame, n: int, capacity: int, turn: int) -> DataFrame:
    parts = max(1, -(-n // PART))
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(turn)), F.lit(parts)).cast("int")

    def pack(key, pdf):
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        lengths = pdf["length"].to_numpy(np.int64)
        where, offset, fill = best_fit_decreasing(lengths, capacity)
        gap = len(fill) - lower_bound(Counter(lengths.tolist()), capacity)
        fills = np.array(fill, np.int64)[where] if len(fill) else where
        out = pdf[["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
        out["sequence_id"] = (np.int64(turn) << 44) + (np.int64(key[0]) << 16) + where
        return out.assign(offset=offset, fill=fills, gap=gap)

    items = items.select("doc_id", "piece", "start", "length", "ids_crc32", salt.alias("_part"))
    return cut(items.repartition(min(parts, 20_000), "_part").groupBy("_part").applyInPandas(pack, _COLUMNS))


def _exchanged(todo: DataFrame, capacity: int) -> DataFrame:
    """Pieces below ``capacity``, packed and exchanged until their number of bins meets the bound over all or nothing is gained."""
    lengths = {r["length"]: r["n"] for r in todo.groupBy("length").agg(F.count("*").alias("n")).collect()}
    bound = lower_bound(lengths, capacity)
    packed = _pack(todo, sum(lengths.values()), capacity, 0)
    bins, turn, everyone = packed.filter("offset = 0").count(), 0, False
    while bins > bound:
        loose = (F.col("fill") < capacity) & (F.lit(everyone) | (F.col("gap") > 0))
        figures = packed.filter(loose).agg(F.count("*").alias("n"), F.count_if(F.col("offset") == 0).alias("bins")).first()
        gained = 0
        if figures["n"]:
            turn += 1
            again = _pack(packed.filter(loose), figures["n"], capacity, turn)
            gained = figures["bins"] - again.filter("offset = 0").count()
        if gained > 0:
            packed, bins = cut(packed.filter(~loose).unionByName(again)), bins - gained
        elif everyone:
            break
        else:
            everyone = True
    return packed


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece with its sequence and its place there; no sequence exceeds ``capacity``.

    A null text counts as empty (one piece: the end id). Repeated rows are packed each. Ties in length go by doc_id, then piece. Null ids
    stay null. An empty table gives an empty result. Texts of any length are cut into full pieces, each a sequence of its own.
    """
    todo = cut(pieces_of(docs, vocabulary, capacity, id_col=id_col, text_col=text_col))
    full = todo.filter(F.col("length") == capacity).select("*", ((F.lit(127).cast("long") * (1 << 56)) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    todo = todo.filter(F.col("length") < capacity)
    names = full.columns
    return full.unionByName(_exchanged(todo, capacity).select(names))
