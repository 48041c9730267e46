"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontamination, fill_in_middle, html_extraction, language_id, line_dedup, neighbours, packing, quality, sharding, simhash, sql, token_counts, web_archive
from .common import BENCHMARK, DOCUMENTS, EMBEDDINGS, LABELS, PAGES, read


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, DOCUMENTS), vocabulary_path())


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, DOCUMENTS).select("doc_id", "text", "lang")
    model = language_id.learn(docs.filter(language_id.remainder(F.col("doc_id")) != 0))
    out = language_id.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (language_id.remainder(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read(spark, sf_dir, DOCUMENTS), read(spark, sf_dir, BENCHMARK))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, DOCUMENTS), vocabulary_path())


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read(spark, sf_dir, DOCUMENTS))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, DOCUMENTS)).drop("_row")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, EMBEDDINGS))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, DOCUMENTS))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(read(spark, sf_dir, PAGES)).withColumn("n_chars", F.char_length("text").cast("long"))


def op10_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(read(spark, sf_dir, DOCUMENTS), read(spark, sf_dir, LABELS))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = web_archive.archive(read(spark, sf_dir, PAGES))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "position")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, EMBEDDINGS))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.fill_in_middle(read(spark, sf_dir, DOCUMENTS))
    whole = fill_in_middle.restored(F.col("form"), F.col("output"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(whole).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (
        op1_token_counts, op2_language_id, op3_decontamination, op4_best_fit_packing, op5_simhash, op6_line_dedup, op7_nearest_neighbours, op8_sharding,
        op9_html_extraction, op10_quality_resampling, op11_warc, op12_centroid_clustering, op13_fill_in_middle,
    )}
ORACLE_SQL: dict[str, str] = {"op11_warc": sql.ARCHIVE, "op12_centroid_clustering": sql.clusters(), "op13_fill_in_middle": sql.FILL_IN_MIDDLE}
