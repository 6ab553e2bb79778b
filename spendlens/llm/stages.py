"""The stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm import bpe, decontam, jaccard, lines, subword
from spendlens.llm.common import table, workers_import


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labels of these documents, does not reject.

    A null or empty text scores 0 and goes, as a long one is scored whole.  Rows
    that repeat are kept or go together; a null key is scored, but teaches
    nothing.  Other columns stay as they are.  An empty table stays empty.
    """
    model = subword.fit(docs, table(spark, sf_dir, "labels"))
    return subword.score(docs, model).filter(F.col("score") >= 0.5).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more, and those of over 50 words found in two, stay where they occur first.

    First is the least key, a null one before all, and there the first line.  A
    null text becomes an empty one; rows that repeat count as documents each
    and share a first occurrence.  No row goes; other columns stay as they are.
    """
    workers_import(spark)
    return lines.drop_repeated_lines(docs, min_docs=10, keep_first=True, long_words=50).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the least key, a null one before all.

    Texts without words (null, empty) are no copies and stay.  Rows that repeat
    with one key stay or go together.  Columns and texts of those that stay are unchanged.
    """
    workers_import(spark)
    return jaccard.keep_one(docs, jaccard.jaccard_classes(docs)).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item, unchanged.

    Null and empty texts have no window and stay; long ones are scanned whole;
    rows that repeat stay or go together.  Items without key count, those without words do not.
    """
    found = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return decontam.remove_leaks(found, whole=True).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids of the text and their number, and whether decoding them gives the text back.

    A null text counts as empty and has no ids.  A row for each row, also for
    those that repeat; long texts are encoded whole; other columns are not read.
    """
    workers_import(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_checked(docs, path, public_tokenizers.PATTERN, remembered=60_000)
