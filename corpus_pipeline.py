"""A training-data pipeline: each stage takes the documents that the one before kept, and its decisions take effect.

STAGES are (name, function) pairs; a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import common, decontaminate, jaccard_join, language_id, piece_codec, quality_cascade


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; texts without a letter and doubtful predictions go."""
    return language_id.keep(docs)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the cascade rejects stay."""
    return quality_cascade.keep(docs)


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles, Jaccard 0.8 or more): the least doc_id."""
    return jaccard_join.keep_one(docs, shingle=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item stay."""
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and checks of what the ids decode to."""
    return piece_codec.encode(docs)


STAGES = [
    ("language_id", language_stage),
    ("quality_rules", quality_stage),
    ("jaccard_join", duplicates_stage),
    ("decontamination", decontamination_stage),
    ("piece_encoding", encoding_stage),
]

#: Language prediction by trained SVMs and the best-scoring segmentation are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
        common.dropped(docs)
        docs = out
    return docs
