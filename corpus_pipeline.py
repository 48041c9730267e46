"""A corpus pipeline over ``documents``: language ID, line dedup, near-dedup by SimHash and shingles, benchmark decontamination, packing.

Every stage keeps the columns of documents, but for the last, which returns the packed pieces. Nulls, repeated rows and
empty tables are defined as in the operators; stages tell rows apart by a row number of their own, whose name is free, so repeated
ids and columns of any name are safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm import decontamination, language_id, line_dedup, near_copies, packing
from tidewave.llm.common import BENCHMARK, DOCUMENTS, cut, free_name, numbered, read, sized
from tidewave.llm.queries import vocabulary_path


def _rows(docs: DataFrame) -> tuple[DataFrame, str]:
    row = free_name([*docs.columns, "row", "text", "doc", "removed"], "_row")
    return numbered(docs, row), row


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of no language: null texts and texts without letters. A null ``lang`` becomes the language predicted."""
    model = language_id.learn(docs.filter(language_id.remainder(F.col("doc_id")) != 0))
    name = free_name(docs.columns, "_lang")
    out = docs.withColumn(name, language_id.predicted(model)(F.col("text"))).filter(F.col(f"{name}.lang_pred") != "und")
    return out.withColumn("lang", F.coalesce("lang", F.col(f"{name}.lang_pred"))).select(docs.columns)


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated lines; documents that keep no visible text go. n_chars follows the new text."""
    rows, row = _rows(docs)
    gone = line_dedup.removed_lines(rows, row)
    name = free_name(rows.columns, "_removed")
    out = rows.join(gone.withColumnRenamed("removed", name), row, "left")
    out = out.withColumn("text", line_dedup.without("text", name)).filter(r"text RLIKE '\\S'")
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def stage_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: Jaccard similarity of 0.8 or more on five-word shingles."""
    rows, row = _rows(docs)
    return rows.join(sized(near_copies.later_copies(rows, row), F.lit(16)), row, "left_anti").select(docs.columns)


def stage_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    rows, row = _rows(docs)
    hits = decontamination.contaminated(rows, read(spark, sf_dir, BENCHMARK), id_col=row).select(F.col("doc_id").alias(row)).distinct()
    return rows.join(sized(hits, F.lit(16)), row, "left_anti").select(docs.columns)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary_path())


STAGES = [
    ("language_id", stage_language),
    ("line_dedup", stage_lines),
    ("simhash", stage_near_copies),
    ("decontamination", stage_benchmark),
    ("packing", stage_packing),
]

#: Line similarity, near-copy components and tokenization have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, DOCUMENTS)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1]:
            docs = cut(docs)
    return docs
