"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, interpolated_lm, kmeans_tree, language_id, line_dedup, mixing, near_dedup, sstable, suffix_dedup, token_counts
from .common import crc_mod, cut, shared_path, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = crc_mod("doc_id", 5) == 0
    model = language_id.fit(spark, docs.where(~held))
    return language_id.predict(spark, docs, model).withColumn("held_out", held).select("doc_id", "held_out", "lang_pred", "score")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_recurring(spark, table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(spark, table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op4_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = crc_mod("doc_id", 7) == 2
    return interpolated_lm.score(spark, docs, ~held).withColumn("held_out", held)


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree.search(spark, table(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_table(spark, table(spark, sf_dir, "documents"), max_repeat=MAX_REPEAT)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.flag(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.token_output(spark, table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_dedup.dedup(spark, table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents enter with an estimate of their tokens; exact counts of a public tokenizer follow as revisions, a second version (ids of raw bytes) as inserts, toxic documents as deletes. One batch is delivered twice."""
    docs = table(spark, sf_dir, "documents")
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    counted = docs.select("doc_id", "source", "lang", F.ceil(F.coalesce("n_chars", F.lit(0)) / 6).cast("long").alias("old"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), "text")
    counted = cut(spark, token_counts.token_counts(counted), "counted")
    bpe = counted.withColumn("version", F.lit("byte_bpe_50k"))
    octets = counted.withColumn("version", F.lit("bytes")).withColumn("n", F.col("bytes"))
    ledger = token_counts.Ledger(spark, shared_path(spark, "ledger"))
    ledger.apply("load", token_counts.inserts(bpe.withColumn("n", F.col("old"))))
    ledger.apply("exact", token_counts.revisions(bpe))
    ledger.apply("bytes", token_counts.inserts(octets))
    ledger.apply("exact", token_counts.revisions(bpe))
    ledger.compact()
    ledger.apply("toxic", token_counts.deletes(bpe.unionByName(octets).join(toxic, "doc_id", "left_semi")))
    return ledger.totals()


MAX_REPEAT = 1.25

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_line_dedup": op2_line_dedup,
    "op3_near_dedup": op3_near_dedup,
    "op4_deleted_interpolation": op4_deleted_interpolation,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_mixing": op6_mixing,
    "op7_decontaminate": op7_decontaminate,
    "op8_token_output": op8_token_output,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_token_counts": op10_token_counts,
}

SQL: dict[str, str] = {
    "op2_line_dedup": line_dedup.SQL,
    "op6_mixing": mixing.SQL.replace("{max_repeat}", str(MAX_REPEAT)),
}
