"""Cleaning a corpus of documents: bad ones go, one of each group of near copies stays, repeated passages and
leaked benchmark items go, and what is left is encoded.

Each stage reads what the stage before it kept; ``run`` writes that to the folder that
driver and executors share, since stages read their input more than once.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontamination, jaccard, quality, substrings
from tessera.llm.common import table, written
from tessera.llm.queries import fold

#: Not expressible in SQL: trained weights and byte pairs. The tests hold run() against a brute-force version.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; it learns from the labels of ``sf_dir``."""
    weights, bias = quality.fit(docs, table(spark, sf_dir, "labels"), "quality", fold(3) != 1)
    return quality.keep_good(docs, weights, bias)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles."""
    return jaccard.keep_one(docs, n=5, percent=80)


def no_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of 20-word windows that occur earlier; n_chars counts what is left."""
    kept = substrings.remove_repeats(docs, n_words=None, n_removed=None)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns) if "n_chars" in docs.columns else kept


def no_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of each document that is left."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", good_quality), ("near_copies", no_near_copies), ("repeats", no_repeats), ("benchmark", no_benchmark_items), ("encoding", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
