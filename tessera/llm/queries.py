"""Registered queries of this subpackage; each reads whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bitsliced, bpe, changepoints, decontamination, jaccard, language, licences, quality, spelling, substrings, syncmers, toxicity, warc
from tessera.llm.common import table
from tessera.llm.oracles import ORACLES


def fold(of: int) -> Column:
    """crc32 of the doc_id as text, modulo ``of``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string")) % of


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = bitsliced.index(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return bitsliced.search(blocks, k=20)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), rejoin=True)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"), n=3, percent=90)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, fold(5) != 0)
    found = language.predict(docs, model)
    return found.select("doc_id", (fold(5) == 0).alias("held_out"), "lang_pred", "score")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    machine = toxicity.fit(docs, labels, "toxic", fold(3) != 1)
    scored = toxicity.score(docs, machine)
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights, bias = quality.fit(docs, labels, "quality", fold(3) != 1)
    scored = quality.score(docs, weights, bias)
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op9_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).drop("url", "payload")


def op10_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents")).drop("spans")


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_fingerprints(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), slips=97))


def op13_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "sale_lines").where("flag = 'kept'")
    daily = changepoints.daily_totals(lines, "vendor_id", F.col("shipped_at"), F.col("quantity"))
    return changepoints.segments(daily).withColumnRenamed("key", "vendor_id")


def licence_base_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10_licence_scan that SQL can express."""
    return op10_licence_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op")} | {"licence_base_places": licence_base_places}


def oracle_sql() -> dict:
    return dict(ORACLES)
