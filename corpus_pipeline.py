"""A corpus pipeline over `documents`: classify, remove near-duplicates and repeated passages, sanitise, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import neardup, packing, pii, quality, substring
from loomgraph.llm.common import table
from loomgraph.session import Scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts."""
    return quality.keep_quality(docs, table(spark, sf_dir, "labels"))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: that of the least doc_id."""
    return neardup.drop_near_duplicates(spark, docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document has; documents that were nothing else go."""
    return substring.drop_repeated_passages(spark, docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and the terms that disclose them replaced."""
    return pii.sanitise(spark, docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces and their places in sequences of 2048 tokens."""
    return packing.pack_documents(spark, docs)


STAGES = [("quality", quality_stage), ("neardup", neardup_stage), ("substring", substring_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: The stages hold a trained model, MinHash and a subword tokenizer, which SQL cannot express; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written as Parquet to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
