"""A corpus pipeline: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spendlens.llm import stages
from spendlens.llm.common import kept, table

STAGES = [
    ("quality_classifier", stages.quality),
    ("line_dedup", stages.drop_lines),
    ("jaccard_join", stages.near_duplicates),
    ("decontamination", stages.decontaminate),
    ("byte_bpe", stages.tokenize),
]

#: SQL cannot express the trained classifier, MinHash or byte pair merges; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name)
    return docs
