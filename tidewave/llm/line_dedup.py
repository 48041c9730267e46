"""Line dedup by an exact set-similarity join.

A line is the set of its words. Words are ordered by rarity; two sets with Jaccard similarity t or more share a word among
their |x| - ceil(t|x|) + 1 rarest, so only these are indexed (prefix filter). Pairs that meet there pass a length, a
positional and a parity filter (differing bits of 128 parities never exceed differing words) and are then verified on their
words. Equal sets are one node, told by a 64-bit sum of word hashes, their number and 128 parities of other hashes. Rarity
comes from counts in a fixed number of hashed slots, and the index names words by 32 bits: any fixed order and any merging of
words only adds candidates, never loses a pair.

A line goes if one earlier line is near it, so not all near pairs are wanted. Sets that agree in a min-wise signature first
meet the first set of that signature; where that one is near, the set is resolved. By the prefix join the sets still not resolved
then meet all. So most of a group of near copies costs its size, not its square.

Texts travel once, keyed by row; the index holds numbers only.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, numbered, release, sized, slot_counts, tidy

JACCARD = 0.8
#: Lines of fewer distinct words never go; 1 lets every line take part that is not blank.
LEAST_WORDS = 1
SLOTS = 1 << 20
#: Texts are parsed in chunks of about this many characters; a longer text is a chunk of its own.
CHUNK = 4 << 20
#: Min-wise signatures a set has, and the permutations joined in each.
SIGNATURES, JOINED = 4, 2
_ODD = [(0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64) | 1 for k in range(SIGNATURES * JOINED)]


def words_of(line: str) -> set[bytes]:
    """The words of a line: lower case, split at ASCII white space."""
    return set(line.lower().encode().split())


def _chunks(batches, least: int):
    """(row numbers, line numbers, words' codes flat, words a line, vocabulary) of lines with ``least`` words or more."""
    for batch in batches:
        size, vocabulary = 0, defaultdict()
        vocabulary.default_factory = vocabulary.__len__
        codes, at, numbers, sizes = array("q"), array("q"), array("i"), array("q")
        for i, text in enumerate(batch.column("text")):
            text = text.as_py()
            if text is None:
                continue
            for no, line in enumerate(text.lower().encode().split(b"\n")):
                words = line.split()
                if len(words) >= least:
                    codes.extend(map(vocabulary.__getitem__, words))
                    at.append(i)
                    numbers.append(no)
                    sizes.append(len(words))
            size += len(text)
            if size >= CHUNK:
                if len(at):
                    yield batch, np.array(at), np.array(numbers), np.array(codes), np.array(sizes), vocabulary
                size, vocabulary = 0, defaultdict()
                vocabulary.default_factory = vocabulary.__len__
                codes, at, numbers, sizes = array("q"), array("q"), array("i"), array("q")
        if len(at):
            yield batch, np.array(at), np.array(numbers), np.array(codes), np.array(sizes), vocabulary


def _hashes(vocabulary, seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in vocabulary), np.uint64, len(vocabulary))


def _order(docs: DataFrame):
    """Broadcast of word counts by slot, the rarity that orders words."""

    def count(batches, total):
        some = Counter()

        def flush():
            slots = (_hashes(some, 1) & np.uint64(SLOTS - 1)).astype(np.int64)
            np.add.at(total, slots, np.fromiter(some.values(), np.int64, len(some)))
            some.clear()

        for batch in batches:
            for text in batch.column("text"):
                text = text.as_py()
                if text:
                    some.update(text.lower().encode().split())
                    if len(some) > 150_000:
                        flush()
        flush()

    return slot_counts(docs.select("text"), count, SLOTS)


def _lines(docs: DataFrame, row: str, held, jaccard: float, least: int) -> DataFrame:
    """One row a line of ``least`` distinct words or more: its place, set key (k, n, p1, p2), signatures and rarest words.

    ``prefix`` leaves out words no other line has, and is empty for sets too small to be near an unequal one.
    """

    def parse(batches):
        for batch, at, numbers, codes, sizes, vocabulary in _chunks(batches, least):
            h1, h2 = _hashes(vocabulary, 1), _hashes(vocabulary, 2)
            short = (h1 & np.uint64(0xFFFFFFFF)).astype(np.int64)
            often = held.value[short & (SLOTS - 1)]
            order = np.lexsort((h1, short, often))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            spread = np.repeat(np.arange(len(sizes)) * len(order), sizes) + rank[codes]
            spread.sort()
            spread = spread[np.concatenate(([True], spread[1:] != spread[:-1]))]
            line, code = spread // len(order), order[spread % len(order)]
            n = np.bincount(line, minlength=len(sizes))
            starts = np.concatenate(([0], np.cumsum(n)[:-1]))
            key = np.add.reduceat(h1[code], starts).view(np.int64)
            # Each word flips one of 128 parities, held in two numbers.
            bit = np.left_shift(np.uint64(1), h2 & np.uint64(63))
            low = ((h2 >> np.uint64(6)) & np.uint64(1)).astype(bool)
            p1, p2 = (np.bitwise_xor.reduceat(np.where(side, bit, np.uint64(0))[code], starts).view(np.int64) for side in (low, ~low))
            signs = []
            for j in range(SIGNATURES):
                sign = np.zeros(len(n), np.uint64)
                for k in range(JOINED):
                    least_of = np.minimum.reduceat(((h2 ^ (h2 >> np.uint64(31))) * np.uint64(_ODD[j * JOINED + k]))[code], starts)
                    sign = (sign * np.uint64(_ODD[0]) + least_of) * np.uint64(_ODD[1])
                signs.append(((sign >> np.uint64(33)).astype(np.int64) * SIGNATURES + j).astype(np.int64))
            kept = n >= least
            small = n <= np.floor(jaccard / (1 - jaccard) + 1e-9).astype(np.int64) - 1 if jaccard < 1 else np.ones(len(n), bool)
            lead = np.where(small, 0, n - np.ceil(jaccard * n - 1e-9).astype(np.int64) + 1)[kept]
            ends = np.cumsum(lead)
            place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lead, lead)
            first = code[np.repeat(starts[kept], lead) + place]
            shared = often[first] > 1
            owner = np.repeat(np.arange(len(lead)), lead)[shared]
            bounds = pa.array(np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(lead))))).astype(np.int32))
            prefix, places = (pa.ListArray.from_arrays(bounds, pa.array(x[shared])) for x in (short[first].astype(np.uint32).view(np.int32), place.astype(np.int32)))
            sign = pa.ListArray.from_arrays(pa.array((np.arange(len(lead) + 1) * SIGNATURES).astype(np.int32)), pa.array(np.stack(signs, axis=1)[kept].ravel()))
            rows = pa.array(at[kept])
            columns = [batch.column("row").take(rows), batch.column("doc").take(rows), *[pa.array(x[kept]) for x in (numbers, key, n.astype(np.int32), p1, p2)], sign, prefix, places]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc", "line", "k", "n", "p1", "p2", "signs", "prefix", "places"])
        tidy()

    kind = docs.schema["doc"].dataType.simpleString()
    schema = f"row long, doc {kind}, line int, k long, n int, p1 long, p2 long, signs array<long>, prefix array<int>, places array<int>"
    return docs.select(F.col(row).alias("row"), "doc", "text").mapInArrow(parse, schema)


def _place(prefix: str = ""):
    doc = F.col(f"{prefix}doc")
    return F.struct(doc.isNull().alias("none"), doc.alias("doc"), F.col(f"{prefix}row").alias("row"), F.col(f"{prefix}line").alias("line"))


def _alike(jaccard: float):
    """The condition on entries x and y of one word: length, positional and parity filter."""
    need = F.ceil(F.lit(jaccard / (1 + jaccard)) * (F.col("x_n") + F.col("y_n")) - 1e-9)
    apart = F.bit_count(F.col("x_p1").bitwiseXOR(F.col("y_p1"))) + F.bit_count(F.col("x_p2").bitwiseXOR(F.col("y_p2")))
    near = F.least("x_n", "y_n") >= F.lit(jaccard) * F.greatest("x_n", "y_n") - 1e-9
    return near & (apart <= F.col("x_n") + F.col("y_n") - 2 * need), need


def _sides(x: DataFrame, y: DataFrame, columns: list[str]) -> list[DataFrame]:
    return [d.select(*[F.col(c).alias(f"{p}_{c}") for c in columns]) for p, d in (("x", x), ("y", y))]


def _by_signature(sets: DataFrame, jaccard: float) -> DataFrame:
    """Pairs (a, b), a < b, of sets and a first set of one of their signatures that pass the filters.

    The first set is that of the least document (least row, if documents have no whole numbers as ids), so it is earlier than the others.
    """
    first = "doc" if sets.schema["doc"].dataType.typeName() in ("byte", "short", "integer", "long") else "row"
    entries = sets.filter(F.col("n") > 1).select(F.explode("signs").alias("sign"), F.col(first).alias("first"), "node", "n", "p1", "p2")
    least = entries.groupBy("sign").agg(F.min("first").alias("first"), F.max("first").alias("last")).filter("first < last").select("sign", "first")
    x, y = _sides(least.join(entries, ["sign", "first"]), entries, ["sign", "first", "node", "n", "p1", "p2"])
    alike, _ = _alike(jaccard)
    met = x.join(y, (F.col("x_sign") == F.col("y_sign")) & (F.col("x_node") != F.col("y_node")) & alike)
    return cut(met.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct())


def _entries(sets: DataFrame) -> DataFrame:
    """One row a prefix word of each set."""
    both = F.arrays_zip(F.col("prefix").alias("word"), F.col("places").alias("at"))
    return sets.select("node", "n", "p1", "p2", F.explode(both).alias("e")).select("node", "n", "p1", "p2", "e.word", "e.at")


def _meet(left: DataFrame, right: DataFrame, order, jaccard: float) -> DataFrame:
    """Pairs (a, b), a < b, of entries of one word that pass the filters and ``order``, a condition on x_node and y_node."""
    alike, need = _alike(jaccard)
    # Words before either place may all be shared at best, those behind as many as the shorter rest has.
    reach = F.least("x_at", "y_at") + F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))
    x, y = _sides(left, right, ["word", "node", "n", "p1", "p2", "at"])
    met = x.join(y, (F.col("x_word") == F.col("y_word")) & order & alike & (reach >= need))
    return met.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b"))


def _by_prefix(sets: DataFrame, done: DataFrame, jaccard: float) -> DataFrame:
    """Pairs (a, b), a < b, of sets that share a word of their prefixes and pass the filters; one of the two is not ``done``."""
    marked = sets.filter(F.size("prefix") > 0).join(done.withColumn("done", F.lit(True)), "node", "left")
    todo, rest = _entries(marked.filter("done IS NULL")), _entries(marked.filter("done"))
    own = _meet(todo, todo, F.col("x_node") < F.col("y_node"), jaccard)
    return cut(own.union(_meet(rest, todo, F.col("x_node") != F.col("y_node"), jaccard)).distinct())


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, row: str, jaccard: float) -> DataFrame:
    """The pairs (a, b) whose lines reach the similarity. Only lines of candidates are taken from their documents."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    spots = sets.select("node", "row", "line").join(nodes, "node")
    wanted = sized(spots.groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct("line", "node")).alias("wanted")), 48 + 16 * F.size("wanted"))

    def take(batches):
        for batch in batches:
            node, words = [], []
            for text, lines in zip(batch.column("text"), batch.column("wanted")):
                parts = text.as_py().split("\n")
                for spot in lines.as_py():
                    node.append(spot["node"])
                    h = sorted({xxhash.xxh64_intdigest(w, 1) for w in parts[spot["line"]].lower().encode().split()})
                    words.append(np.array(h, np.uint64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(words, pa.binary())], names=["node", "words"])

    lines = cut(docs.select(row, "text").join(wanted, row).select("text", "wanted").mapInArrow(take, "node long, words binary"))
    a, b = (lines.select(F.col("node").alias(q), F.col("words").alias(f"{q}_words")) for q in "ab")

    def check(batches):
        for batch in batches:
            fine = []
            for left, right in zip(batch.column("a_words"), batch.column("b_words")):
                left, right = (np.frombuffer(s.as_buffer(), np.uint64) for s in (left, right))
                shared = len(left) + len(right) - len(np.unique(np.concatenate((left, right))))
                fine.append(shared >= jaccard * (len(left) + len(right) - shared) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))

    out = cut(pairs.join(a, "a").join(b, "b").select("a", "b", "a_words", "b_words").mapInArrow(check, "a long, b long"))
    release(wanted, lines)
    return out


def _earliest(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, near): the first earlier place among the partners of each set that has one."""
    place = sets.select("node", _place().alias("place"))
    a, b = (place.select(F.col("node").alias(q), F.col("place").alias(f"{q}_place")) for q in "ab")
    both = pairs.join(a, "a").join(b, "b")
    later = F.when(F.col("a_place") < F.col("b_place"), F.struct(F.col("b").alias("node"), F.col("a_place").alias("near"))).otherwise(F.struct(F.col("a").alias("node"), F.col("b_place").alias("near")))
    return cut(both.select(later.alias("s")).select("s.*").groupBy("node").agg(F.min("near").alias("near")))


def removed_lines(docs: DataFrame, row: str, *, jaccard: float = JACCARD, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, removed): the sorted numbers of the lines that go, of each row of ``docs`` that loses some. ``row`` names rows."""
    least = max(1, least_words)
    docs = docs.select(row, F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    lines = cut(_lines(docs, row, _order(docs), jaccard, least))
    first = F.min(F.struct(_place().alias("place"), "signs", "prefix", "places")).alias("f")
    sets = lines.groupBy("k", "n", "p1", "p2").agg(first, F.count("*").alias("copies"))
    sets = sets.select("k", "n", "p1", "p2", "copies", "f.place.doc", "f.place.row", "f.place.line", "f.signs", "f.prefix", "f.places")
    sets = cut(sets.withColumn("node", F.monotonically_increasing_id()))
    if not sets.limit(1).count():
        return lines.select(F.col("row").alias(row), F.array("line").alias("removed"))
    met = _by_signature(sets, jaccard)
    early = _earliest(sets, _verified(met, sets, docs, row, jaccard))
    pairs = _by_prefix(sets, sized(early.select("node"), F.lit(16)), jaccard)
    near = early.union(_earliest(sets, _verified(pairs, sets, docs, row, jaccard)))
    release(met, pairs)
    near = near.groupBy("node").agg(F.min("near").alias("near"))
    # A line that others equal or come near to is looked up; one key may own many lines, so the table has one row a key.
    table = sets.select("k", "n", "p1", "p2", "copies", "node", _place().alias("place")).join(near, "node", "left").filter("copies > 1 OR near IS NOT NULL")
    table = sized(table.select("k", "n", "p1", "p2", F.coalesce("near", "place").alias("earliest")), F.lit(96))
    gone = lines.select("k", "n", "p1", "p2", "row", "line", _place().alias("place")).join(table, ["k", "n", "p1", "p2"]).filter(F.col("place") > F.col("earliest"))
    out = sized(gone.groupBy(F.col("row").alias(row)).agg(F.array_sort(F.collect_list("line")).alias("removed")), 48 + 8 * F.size("removed"))
    release(lines, sets, table)
    return out


def without(text: str, removed: str):
    """The text column without the lines whose numbers the column ``removed`` lists; a null list takes none."""
    parts = F.split(text, "\n")
    stay = F.transform(F.array(parts), lambda p: F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col(removed)), lambda i: F.get(p, i)))[0]
    return F.when(F.coalesce(F.size(removed), F.lit(0)) <= 0, F.col(text)).otherwise(F.array_join(stay, "\n"))


def dedup_lines(docs: DataFrame, *, jaccard: float = JACCARD, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, text without its repeated lines, n_lines, n_removed, removed (line numbers from 0).

    A line goes if an earlier line (by doc_id, row, line number; null ids last) reaches the similarity, be that line kept or not. Blank
    lines and lines of fewer than ``least_words`` distinct words stay. A null text stays null with 0 lines; an empty one has one
    empty line. Repeated rows are documents of their own, so the later ones lose their lines and keep an empty text. Texts of any
    length are read whole. Other columns are not read, whatever their names. An empty table gives an empty result.
    """
    row = free_name([id_col, text_col, "doc", "text", "doc_id", "removed"], "_row")
    docs = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), row)
    gone = removed_lines(docs, row, jaccard=jaccard, least_words=least_words)
    out = docs.join(gone, row, "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    return out.select("doc_id", without("text", "removed").alias("text"), lines.alias("n_lines"), F.size("removed").alias("n_removed"), "removed")
