"""Fill-in-middle by a two-pass streaming matcher: texts are reordered to prefix, suffix and middle, cut between units.

The first pass counts a text's units. The ranks of the two cuts follow from the count, and the second pass advances a lazy match iterator
to the first and on to the second; what is kept of it are two offsets. No list of units exists at any time, so a text costs its own
size in memory, whatever the number of its units.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy

# Blanks of a unit, the unit, the marks and the forms.
BLANK = r"\x20\x09-\x0D"
UNIT = re.compile(rf"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"

#: Characters of output that are collected before they are sent on.
CHUNK = 4 << 20
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def cuts(text: str, first: int, second: int) -> tuple[int, int, int]:
    """(units, end of the prefix, end of the middle): the cuts lie behind ``first % (n + 1)`` and ``second % (n + 1)`` units, in order."""
    n = sum(1 for _ in UNIT.finditer(text))
    low, high = sorted((first % (n + 1), second % (n + 1)))
    matches, ends, at = UNIT.finditer(text), [], 0
    for rank in (low, high):
        last = next(islice(matches, rank - at - 1, None)).end() if rank > at else None
        ends.append(last if last is not None else ends[-1] if ends else 0)
        at = rank
    return n, ends[0], ends[1]


def transform(doc_id: int | None, text: str, rate: int, spm: int, seed: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, of the middle, output) of one text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n, a, b = cuts(text, h1, h2)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return n, PLAIN, None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return n, SPM, a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, PSM, a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, *, rate: int = 50, spm: int = 80, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of ``docs``.

    ``rate`` of 100 texts are reordered, ``spm`` of 100 of these with the suffix first; a hash of ``seed`` and the id decides, so repeated
    rows share their fate. A null text is an empty one; empty texts and those that hold a mark stay plain, with null lengths. A null id
    is hashed as no digits. An empty table gives an empty result. Other columns are not read, whatever their names.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

        def sent(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        rows, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                doc_id = doc_id.as_py()
                rows.append((doc_id, *transform(doc_id, text.as_py() or "", rate, spm, seed)))
                size += len(rows[-1][-1])
                if size >= CHUNK:
                    yield sent(rows)
                    rows, size = [], 0
        if rows:
            yield sent(rows)
        tidy()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, SCHEMA)


def restored(form: Column, output: Column) -> Column:
    """The text ``output`` was made from. Marks occur in no reordered text, so exactly three split such an output."""
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == PSM, F.concat(part[1], part[3], part[2])).when(form == SPM, F.concat(part[2], part[3], part[1])).otherwise(output)
