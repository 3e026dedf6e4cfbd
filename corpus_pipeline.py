"""The corpus pipeline: five stages from documents to token shards.

Each stage works on all rows that the one before it kept, and is written as
Parquet to the shared folder and read again. All but the last return the
columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barsift.cluster import ship
from barsift.llm import decontaminate, language_id, mixing, near_dedup, sstable
from barsift.llm.common import cut, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled rows; rows without a determinable language go."""
    ship(spark)
    return language_id.keep_identified(spark, docs, language_id.fit(spark, docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 stays."""
    ship(spark)
    return near_dedup.keep_one(spark, docs, shingle=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to 15 in 100 of its words edited, go."""
    ship(spark)
    return decontaminate.drop_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at tempered shares of as many tokens as there are; no source more than 1.25 times."""
    ship(spark)
    return mixing.mix(spark, docs, max_repeat=1.25).select("row.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id shards, read back."""
    ship(spark)
    return sstable.token_output(spark, docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark),
    ("source mixing", mix_sources),
    ("token output", write_tokens),
]

#: Trained models and edit distances are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
