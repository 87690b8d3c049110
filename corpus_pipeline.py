"""A training corpus from documents: five stages, each over all rows that the one before kept.

All stages but the last return the columns of documents. Null and repeated doc_ids are kept by each
stage's own rule; no row is lost for its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronika.llm import bpe, decontaminate, langid, simhash, suffix_dedup
from chronika.llm.common import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be in no learned language go: no letter, or too far from every profile."""
    fitted = langid.profiles(docs.filter(~F.coalesce(langid.held_out(), F.lit(False))))
    return langid.accepted(docs, fitted)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays, the one with the smallest doc_id; rows without one come last."""
    return simhash.keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a smaller doc_id has go from the texts; n_chars follows."""
    return suffix_dedup.dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids, n_tokens and whether the ids decode to the text (lossless)."""
    return bpe.encode_rows(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]
#: No SQL: compression, hashing and BPE have no counterpart in it. tests/llm/test_pipeline.py holds it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
