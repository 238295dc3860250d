"""From raw documents to padded batches: quality filter, exact and near deduplication, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sigwarn.llm import exact_dedup, jaccard, packing, pii, quality
from sigwarn.llm.store import discard, materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; null texts count as empty, repeated rows are judged each, no rows give none."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, that with the largest id; null and empty texts are equal, a null id loses, rows that repeat one become one."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that chains of similarity 0.8 or more on five-word shingles connect, that with the smallest id.

    Documents without words are linked with nothing and stay; a null id loses; rows that repeat one become one.
    """
    return jaccard.drop_near_duplicates(docs, n=5, percent=80)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in them replaced by its kind and n_chars set anew; null texts stay null, repeated rows stay."""
    return pii.redact(docs, chars_col="n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bucket, batch and place of each document, a row for every row; null and empty texts have length 0."""
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("personal_data", personal_data_stage), ("packing", packing_stage)]

#: SQL expresses neither the trained stages nor the optimal boundaries; a test holds every stage against a plain version over what its predecessor kept.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir))
        discard(before)
    return docs
