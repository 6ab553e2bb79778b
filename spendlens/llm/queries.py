"""The operators' queries: (spark, sf_dir) -> DataFrame, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm import bpe, counts, decontam, jaccard, lines, merkle, planes, rules, substrings, subword, toxicity, turns, urls
from spendlens.llm.common import shared_path, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = lines.drop_repeated_lines(docs, min_docs=10, keep_first=False)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


URL_RULES = [
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"),
]


@query
def op2_url_filters(spark, sf_dir):
    return urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("purity")


@query
def op3_bit_planes(spark, sf_dir):
    folder = shared_path(spark, "ids")
    path = public_tokenizers.path("byte_bpe_50k.json")
    planes.write_ids(table(spark, sf_dir, "documents"), path, folder, end_id=2)
    return planes.read_ids(spark, folder, digest=True)


@query
def op4_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op5_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return judged(scored, toxicity.CUTOFF)


@query
def op6_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = subword.score(docs, subword.fit(docs, table(spark, sf_dir, "labels")))
    return judged(scored, 0.5)


def judged(scored: DataFrame, cutoff: float) -> DataFrame:
    return scored.select(
        "doc_id", subword.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= cutoff).cast("int").alias("predicted"),
    )


@query
def op7_byte_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query
def op8_decontamination(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


@query
def op9_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op10_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    judged_docs = rules.judge(docs, table(spark, sf_dir, "labels")).drop("n_lines")
    return judged_docs.withColumn("rejected_by", F.array_join("rejected_by", ","))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with faults, by the crc32 of ``conv_id:turn`` mod 20; dropped rows stay as ``absent``."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    role = F.when(kind == 4, "user").otherwise(space("role"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (kind == 0).alias("absent"), copies.alias("copy"))


@query
def op11_conversation_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    found = turns.audits(turns.repair(damaged(rows), absent=F.col("absent")))
    kind = rows.schema["conv_id"].dataType.simpleString()
    return found.select(turns.key_of(F.col("name"), kind).alias("conv_id"), *[c for c in found.columns if c != "name"])


@query
def op12_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.manifest(docs, tampered, lowered)[0]


@query
def op13_substring_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = substrings.drop_repeated_passages(docs)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
