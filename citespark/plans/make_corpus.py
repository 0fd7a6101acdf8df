"""Build, write and describe a corpus from raw CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citespark.operators.corpus import build_corpus, corpus_stats
from citespark.operators.sampling import DEFAULT_SEED
from citespark.sources.raw_csv import read_answers, read_questions
from citespark.sources.tables import write_corpus, write_run_json


def corpus_from_csv(
    spark: SparkSession,
    folder: str,
    output: str,
    n: int | None = None,
    seed: int = DEFAULT_SEED,
    overwrite: bool = False,
) -> DataFrame:
    """Write the corpus and its manifest; returns the written corpus."""
    corpus = build_corpus(read_questions(spark, folder), read_answers(spark, folder), n, seed)
    write_corpus(corpus, output, overwrite)
    written = spark.read.parquet(output)
    manifest = corpus_stats(written).select(
        F.current_timestamp().alias("created_at"),
        F.lit(folder).alias("source_folder"),
        F.lit(output).alias("output_path"),
        F.lit(n).cast("bigint").alias("target_objects"),
        F.lit(seed).alias("seed"),
        F.struct("*").alias("statistics"),
    )
    write_run_json(manifest, f"{output.rstrip('/')}.manifest", overwrite=True)
    return written
