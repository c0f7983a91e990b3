"""Corpus pipeline: toxicity, quality rules, exact and near deduplication, packing. Each stage reads what the one before has written."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barflow.llm import exact, near, packing, quality, toxicity
from barflow.llm.common import read, stored


#: Similarity of word-shingle sets from which on two documents are near-duplicates here, in per cent.
NEAR_PERCENT = 80


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the severity model rejects; the model is fitted on the labelled ones among ``docs``."""
    return toxicity.accepted(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail a rule of the default policy."""
    return quality.passing(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised texts the one with the smallest doc_id stays."""
    return exact.deduplicated(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    return near.one_of_each(docs, percent=NEAR_PERCENT)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 1024 tokens."""
    return packing.public_pack(docs)


STAGES = [("toxicity", toxicity_stage), ("quality_rules", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("packing", packing_stage)]

#: The toxicity model, MinHash and the tokenizer have no SQL form; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``. Every stage's rows are written to the shared folder and read again, so a lost
    executor costs tasks of one stage at most, and no stage is run twice."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
