"""The training-data pipeline: language, near-duplicates, benchmark passages, mixture, token records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from twinframe.llm import op3_decontaminate, op6_records, op7_language, op9_mixing, op10_simhash
from twinframe.session import shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; null texts and texts without a letter go."""
    return op7_language.rejected_dropped(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of every group of fingerprints: 3-word shingles, at most 3 differing bits."""
    return op10_simhash.near_duplicates_dropped(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return op3_decontaminate.contaminated_dropped(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return op9_mixing.mixed(docs)


def records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records of the documents, written and read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    return op6_records.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
    ("mixture", mixture), ("records", records),
]

#: Language mixtures, fingerprints and byte-pair ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again as the next one's input."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
