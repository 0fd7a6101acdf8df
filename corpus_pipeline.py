"""The training-data pipeline: language ID, exact dedup, near dedup, mixing, BPE.

Each stage reads all that its predecessor kept, as Parquet in the shared
folder. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citespark.llm import bpe, exact_dedup, language_id, ngram_join, source_mix
from citespark.llm.queries import tokenizer_file
from citespark.llm.staging import keep_ids, stored

# Languages cannot be told in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no language: no letters, or n-grams that no language has."""
    found = language_id.predict_languages(docs)
    return keep_ids(docs, found.filter(~language_id.is_rejected()).select("doc_id"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    found = ngram_join.jaccard_components(docs)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return keep_ids(docs, kept.select("doc_id"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, so that sources come near their targets."""
    return source_mix.mixed_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row: doc_id, n_tokens, ids, ids_sha256, decoded_sha256."""
    encoded = bpe.bpe_round_trip(docs, tokenizer_file("word_bpe_49k.json"))
    return bpe.with_digests(encoded, keep=["ids"])


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", near_dedup_stage),
    ("mixing sources", mix_stage),
    ("BPE", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from ``documents`` on, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
