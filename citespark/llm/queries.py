"""Registered queries of this subpackage: the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citespark.llm import (
    bpe,
    conversation_repair,
    embedding_dedup,
    exact_dedup,
    importance,
    language_id,
    ngram_join,
    packing,
    secret_scan,
    sharding,
    source_mix,
    token_shards,
    url_filter,
)
from citespark.llm.staging import new_folder, stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return language_id.predict_languages(_table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BPE ids and decoded text of every document, as digests."""
    docs = _table(spark, sf_dir, "documents")
    return bpe.with_digests(bpe.bpe_round_trip(docs, tokenizer_file("word_bpe_49k.json")))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document by pattern and by randomness."""
    return secret_scan.with_digests(secret_scan.scan_secrets(_table(spark, sf_dir, "documents")))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document written to indexed shards and read back from them."""
    path = f"{new_folder(spark)}/tokens"
    docs = _table(spark, sf_dir, "documents")
    token_shards.write_token_shards(docs, path, tokenizer_file("byte_bpe_50k.json"))
    found = token_shards.read_token_shards(spark, path).select(
        "shard", "doc_id", "offset", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )
    return token_shards.document_starts(stored(found, "found")).select(
        "doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset"
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group and surviving row of every document among equal texts."""
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix with source weights 5, 2, 1 takes from every document."""
    return source_mix.mix_sources(_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, shards of near equal bytes."""
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url by rules and path templates."""
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under five-word Jaccard similarity of 0.8."""
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector among those of its label."""
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest repair of every conversation after damage."""
    turns = _table(spark, sf_dir, "conversations")
    pieces = conversation_repair.repair_conversations(conversation_repair.damage(turns))
    found = conversation_repair.with_digests(pieces).withColumnRenamed("conv_id", "found_id")
    ids = turns.select("conv_id").distinct()
    # Ids are unique on both sides.
    every = ids.join(found, ids["conv_id"].eqNullSafe(found["found_id"]), "left")
    zeros = {name: 0 for name in found.columns[1:-2]}
    return every.drop("found_id").fillna({**zeros, "audit": ""}).withColumn(
        "repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))
    )


def op12_importance_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of every document towards the benchmark, and rank of those drawn."""
    return importance.importance_sample(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    ).select("doc_id", "n_features", "weight", "score", "rank")


def op13_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document in sequences of 2,048 ids along a Hilbert curve."""
    docs = _table(spark, sf_dir, "documents")
    pieces = packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset",
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [
    op1_language_id,
    op2_bpe,
    op3_secret_scan,
    op4_token_shards,
    op5_exact_dedup,
    op6_source_mix,
    op7_sharding,
    op8_url_filter,
    op9_ngram_join,
    op10_embedding_dedup,
    op11_conversation_repair,
    op12_importance_sample,
    op13_curve_packing,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in QUERIES} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that SQL can express; tests cover the others by brute force."""
    return {
        "op5_exact_dedup": exact_dedup.SQL,
        "op6_source_mix": source_mix.sql(),
        "op8_url_filter": url_filter.sql(),
        "op9_ngram_join": ngram_join.SQL,
        "op11_conversation_repair": conversation_repair.sql(),
        "op12_importance_sample": importance.sql(),
    }
