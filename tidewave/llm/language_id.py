"""Language identification by language-bitmask n-gram filters.

One Bloom filter for all languages: its slots hold bitmasks, one bit a language, so that a look-up (the AND of an
n-gram's slots) returns all languages that contain the n-gram. A text's hits are counted per language, corrected for that
language's false-positive rate, and the largest count decides.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, small_batches, tidy

HASHES = 3
#: An n-gram belongs to a language if at least this share of its learning documents holds it. So a language has at most
#: (mean distinct n-grams of a document) / SHARE n-grams, however many documents there are.
SHARE = 0.004


#: Which of eight bits each byte has.
_BITS = np.arange(256)[:, None] >> np.arange(8) & 1
#: Code points hashed together; bounds the memory a long text takes.
BLOCK = 1 << 18
_POINT = np.uint64(21)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Per code point: itself if a letter or mark, else a blank; and which ones are letters."""
    import regex

    keep, letter = np.full(0x110000, 0x20, np.uint32), np.zeros(0x110000, bool)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, is_letter in ((r"\p{L}+", True), (r"\p{M}+", False)):
        for m in regex.finditer(pattern, points):
            a, b = (i if i < 0xD800 else i + 0x800 for i in (m.start(), m.end() - 1))
            keep[a : b + 1] = np.arange(a, b + 1)
            letter[a : b + 1] = is_letter
    return keep, letter


def _unique(x: np.ndarray) -> np.ndarray:
    x.sort()
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def grams(text: str | None) -> np.ndarray:
    """Distinct letter n-grams of the whole text, as numbers; empty if it has no letter."""
    keep, letter = _letters()
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not letter[raw].any():
        return np.zeros(0, np.uint64)
    p = np.empty(len(raw) + 2, np.uint64)
    p[0] = p[-1] = 0x20
    p[1:-1] = keep[raw]
    blank = p == 0x20
    p = p[~(blank & np.concatenate(([False], blank[:-1])))]
    parts = []
    for at in range(0, max(1, len(p) - 3), BLOCK):
        q = p[at : at + BLOCK + 3]
        two = (q[:-1] << _POINT) | q[1:]
        three = (two[:-1] << _POINT) | q[2:]
        # Four code points do not fit: a mixed value, which may collide as any hash.
        four = (three[:-1] ^ (three[:-1] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + q[3:]
        parts.append(_unique(np.concatenate((two, three, four))))
    return parts[0] if len(parts) == 1 else _unique(np.concatenate(parts))


def _mix(x: np.ndarray) -> np.ndarray:
    # The finalizer of splitmix64.
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Filter:
    languages: list[str]
    slots: np.ndarray  # (slots, words of 64 languages)
    wrong: np.ndarray  # false-positive rate per language
    default: int

    def __post_init__(self):
        # Up to eight languages fit a byte, and the table the caches of a processor.
        self.small = self.slots[:, 0].astype(np.uint8) if len(self.languages) <= 8 else None

    @classmethod
    def build(cls, languages: list[str], gram: np.ndarray, lang: np.ndarray, default: int) -> Filter:
        m = 1 << max(10, int(16 * max(1, len(gram))).bit_length())
        slots = np.zeros((m, -(-max(1, len(languages)) // 64)), np.uint64)
        for s in cls._places(gram, m):
            np.bitwise_or.at(slots, (s, lang // 64), np.uint64(1) << (lang % 64).astype(np.uint64))
        full = [((slots[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(languages))]
        return cls(languages, slots, np.array(full) ** HASHES, default)

    @staticmethod
    def _places(gram: np.ndarray, m: int):
        h = _mix(gram)
        step = (h >> np.uint64(32)) | np.uint64(1)
        for _ in range(HASHES):
            yield (h & np.uint64(m - 1)).astype(np.int64)
            h = h + step

    def predict(self, text: str | None) -> tuple[str, float]:
        g = grams(text)
        if not len(g) or not self.languages:
            return "und", 0.0
        masks, table = None, self.slots if self.small is None else self.small
        for s in self._places(g, len(table)):
            masks = table[s] if masks is None else masks & table[s]
        if self.small is None:
            hits = np.array([np.count_nonzero(masks[:, k // 64] & np.uint64(1 << k % 64)) for k in range(len(self.languages))])
        else:
            hits = (np.bincount(masks, minlength=256) @ _BITS)[: len(self.languages)]
        true = np.maximum(0, (hits - len(g) * self.wrong) / (1 - np.minimum(self.wrong, 0.999)))
        if true.sum() <= 0:
            return self.languages[self.default], 0.0
        k = int(true.argmax())
        return self.languages[k], float(min(1.0, true[k] / true.sum()))


def learn(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", share: float = SHARE) -> Filter:
    """The filter from all labelled rows. What the driver reads is bounded by ``share``, not by the number of rows."""

    def count(batches):
        held: dict[str, list] = {}

        def merged(parts):
            value, at = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
            return value, np.bincount(at, np.concatenate([n for _, n in parts]), len(value)).astype(np.int64)

        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                # Lists of some documents are merged before the next ones are read, which bounds the memory.
                parts, some, size = held.setdefault(lang, []), [], 0
                for i, t in enumerate(texts):
                    some.append(grams(t))
                    size += len(some[-1])
                    if size > 1 << 20 or i == len(texts) - 1:
                        parts.append(np.unique(np.concatenate(some), return_counts=True))
                        some, size = [], 0
                if sum(len(v) for v, _ in parts) > 1 << 21:
                    parts[:] = [merged(parts)]
        for lang, parts in held.items():
            value, n = merged(parts)
            yield pd.DataFrame({"lang": lang, "gram": value.view(np.int64), "n": n})
        held.clear()
        tidy()

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect())
    languages = [x for x, _ in sizes]
    if not languages:
        return Filter.build([], np.zeros(0, np.uint64), np.zeros(0, np.int64), 0)
    limit = F.create_map(*[F.lit(v) for x, n in sizes for v in (x, max(1.0, share * n))])
    counts = small_batches(rows).mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    kept = counts.filter(F.col("n") >= F.element_at(limit, F.col("lang"))).select("lang", "gram").toPandas()
    number = {x: i for i, x in enumerate(languages)}
    default = max(range(len(sizes)), key=lambda i: (sizes[i][1], -i))
    return Filter.build(languages, kept["gram"].to_numpy(np.int64).view(np.uint64), kept["lang"].map(number).to_numpy(np.int64), default)


def predicted(model: Filter):
    """A column function: struct of lang_pred and score of a text."""

    @F.pandas_udf("lang_pred string, score double")
    def run(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([held.value.predict(t) for t in text], columns=["lang_pred", "score"])

    spark = SparkSession.active()
    small_batches(spark.range(0))
    held = spark.sparkContext.broadcast(model)
    return run


def predict(docs: DataFrame, model: Filter, *, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (share of the corrected hits, 0 to 1) in place of any columns of those names.

    Null texts and texts without letters: ``und``, 0. Ties: the first language by name. A text none of whose n-grams is known: the
    language with most learning documents, score 0. No learned language at all: ``und``. Texts of any length are read whole, in blocks.
    Repeated rows stay; the table may be empty.
    """
    lid = free_name(docs.columns, "_lid")
    out = docs.withColumn(lid, predicted(model)(F.col(text_col))).drop("lang_pred", "score")
    return out.select("*", f"{lid}.lang_pred", f"{lid}.score").drop(lid)


def remainder(doc_id):
    """crc32 of the id as text, mod 5; 0 is held out. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5
