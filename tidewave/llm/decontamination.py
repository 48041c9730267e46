"""Benchmark decontamination: a BM25 index of test items, searched by every training passage with block-max WAND.

Items are the indexed documents, passages the queries. Impacts are divided by the item's own best score, so one threshold
serves all items. Items lie in small blocks with the largest impact per word; the sums of the largest impacts of a passage's words
bound all blocks at once, and only blocks whose bound reaches the threshold are scored, exactly: the retrieved set is that of a full
evaluation. Hits
are verified by word shingles of the item's question and answer (its last sentence).
"""

from __future__ import annotations

import re
from collections import Counter
from math import log
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy

K1, B = 1.2, 0.75
#: Items of a block: the fewer, the closer its bound, and the more blocks to bound.
BLOCK = 8
#: Items of one index; more items are searched in more passes, each with an index of this size.
SLICE = 2048
THRESHOLD, OVERLAP, SHINGLE = 0.6, 0.8, 5
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence is the answer, the rest the question; a single sentence is all question."""
    parts = [w for w in map(words, re.split(r"(?<=[.!?])\s+", text.strip())) if w]
    if len(parts) < 2:
        return (parts[0] if parts else []), []
    return [w for p in parts[:-1] for w in p], parts[-1]


def shingles(tokens: list[str]) -> set[tuple[str, ...]]:
    return {tuple(tokens[i : i + SHINGLE]) for i in range(max(1, len(tokens) - SHINGLE + 1))} if tokens else set()


def overlap(part: list[str], passage: list[str]) -> float:
    """Share of the part's shingles in the passage. A part shorter than a shingle is looked for whole; an empty one is there."""
    if not part:
        return 1.0
    n = min(SHINGLE, len(part))
    there = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
    mine = shingles(part)
    return len(mine & there) / len(mine)


def bag_of(text: str) -> Counter:
    """The words of an item, counted."""
    q, a = question_answer(text)
    return Counter(q + a)


class Statistics(NamedTuple):
    """What scores take from all items that have words: their number, words' document frequencies, mean and largest length."""

    n: int
    df: dict[str, int]
    mean: float
    longest: int


def statistics(bags: list[Counter]) -> Statistics:
    sizes = [sum(b.values()) for b in bags]
    return Statistics(len(bags), Counter(w for b in bags for w in b), sum(sizes) / max(1, len(bags)), max(sizes, default=0))


class Index:
    """Blocks of items. A block keeps the impacts of its own words and the largest impact of each. ``stats`` are of all items, these by default."""

    def __init__(self, items: list[tuple[int, str]], stats: Statistics | None = None):
        self.items = [(i, *question_answer(t)) for i, t in items]
        bags = [Counter(q + a) for _, q, a in self.items]
        keep = [k for k, b in enumerate(bags) if b]
        self.items, bags = [self.items[k] for k in keep], [bags[k] for k in keep]
        n, df, mean, self.longest = stats or statistics(bags)
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for b in bags for w in b}))}
        self.blocks = []
        for at in range(0, len(bags), BLOCK):
            some = bags[at : at + BLOCK]
            local = np.array(sorted({self.vocabulary[w] for b in some for w in b}), np.int64)
            place = {int(w): k for k, w in enumerate(local)}
            impact = np.zeros((len(local), len(some)), np.float32)
            for j, bag in enumerate(some):
                norm = K1 * (1 - B + B * sum(bag.values()) / mean)
                for w, tf in bag.items():
                    impact[place[self.vocabulary[w]], j] = log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + norm)
            impact /= impact.sum(axis=0)
            self.blocks.append((local, impact, impact.max(axis=1)))
        # The largest impact of each word in each block: one look-up tells the blocks worth a look.
        self.largest = np.zeros((len(self.vocabulary), len(self.blocks)), np.float32)
        for k, (local, _, largest) in enumerate(self.blocks):
            self.largest[local, k] = largest

    def search(self, ids: np.ndarray, threshold: float) -> dict[int, float]:
        """Every item (by place) that scores at least ``threshold`` for the distinct word ids of a passage."""
        found = {}
        for k in np.flatnonzero(self.largest[ids].sum(axis=0) >= threshold - 1e-4).tolist():
            local, impact, _ = self.blocks[k]
            at = np.searchsorted(local, ids)
            at[at == len(local)] = 0
            score = impact[at[local[at] == ids]].sum(axis=0)
            for j in np.flatnonzero(score >= threshold - 1e-4).tolist():
                found[k * BLOCK + j] = float(score[j])
        return found

    def matches(self, text: str | None, threshold: float, least: float):
        tokens = words(text)
        get = self.vocabulary.get
        distinct = np.array(sorted(map(get, self.vocabulary.keys() & set(tokens))), np.int64)
        # A whole text scores at least as much as any passage in it, so texts without hits need no passages.
        if not len(distinct) or not self.search(distinct, threshold):
            return
        known = np.array([get(w, -1) for w in tokens], np.int64)
        best: dict[int, tuple] = {}
        step = max(SHINGLE, self.longest)
        for at in range(0, max(1, len(tokens) - step), step):
            passage = slice(at, at + 2 * step)
            ids = np.unique(known[passage])
            for k, score in self.search(ids[ids >= 0], threshold).items():
                item, q, a = self.items[k]
                row = (item, score, overlap(q, tokens[passage]), overlap(a, tokens[passage]))
                if min(row[2:]) >= least and row[1:] > best.get(k, (0, 0.0))[1:]:
                    best[k] = row
        yield from best.values()


def _counted(items: DataFrame) -> DataFrame:
    """(n, words) of each item that has words."""

    def run(batches):
        for pdf in batches:
            bags = [b for b in map(bag_of, pdf["text"]) if b]
            if bags:
                yield pd.DataFrame({"n": [sum(b.values()) for b in bags], "words": [list(b) for b in bags]})

    return items.select("text").mapInPandas(run, "n long, words array<string>")


def _statistics(items: DataFrame) -> Statistics:
    """Number and lengths of all items, without frequencies."""
    r = _counted(items).agg(F.count("*").alias("c"), F.sum("n").alias("total"), F.max("n").alias("most")).first()
    return Statistics(r["c"], {}, (r["total"] or 0) / max(1, r["c"]), r["most"] or 0)


def _frequencies(items: DataFrame, mine: list) -> dict[str, int]:
    """In how many of all items each word of ``mine`` is; the driver holds the words of one slice only."""
    own = items.sparkSession.createDataFrame([(w,) for w in sorted({w for r in mine for w in bag_of(r["text"])})], "w string")
    counts = _counted(items).select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    return {r["w"]: r["df"] for r in counts.join(own, "w").collect()}


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, threshold: float = THRESHOLD, least: float = OVERLAP, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pairs (doc_id, item_id, score, question_overlap, answer_overlap) of documents and the test items they hold.

    Passages are windows of twice the longest item, one item apart, so an item lies whole in some passage. Null and empty texts and items
    match nothing. Repeated rows are reported each; each pair shows its best passage (of equal ones the first). Texts of any length are
    searched whole; other columns are not read. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    items = benchmark.select(F.col("item_id").cast("long"), "text").filter("text IS NOT NULL")
    slices = max(1, -(-items.count() // SLICE))
    out, whole = None, None if slices == 1 else _statistics(items)
    for k in range(slices):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).orderBy("item_id", "text").collect()
        held = spark.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in mine], whole and whole._replace(df=_frequencies(items, mine))))

        def run(batches, held=held):
            for pdf in batches:
                hits = [(d, *m) for d, t in zip(pdf["doc_id"], pdf["text"]) for m in held.value.matches(t, threshold, least)]
                if hits:
                    yield pd.DataFrame(hits, columns=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])
            tidy()

        part = small_batches(rows).mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return out
