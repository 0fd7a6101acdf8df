"""Integrity reports over stored vectors: one scan, one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.functions.vectors import is_finite, is_unit, norm


def vector_report(df: DataFrame, dimension: int, column: str = "embedding") -> DataFrame:
    """Violation counts and norm statistics of a whole vector column."""
    vector = F.col(column)
    flags = df.select(
        F.coalesce(F.size(vector) == dimension, F.lit(False)).alias("_sized"),
        F.coalesce(is_finite(vector), F.lit(False)).alias("_finite"),
        norm(vector).alias("_norm"),
        F.coalesce(is_unit(vector), F.lit(False)).alias("_unit"),
    )
    return flags.agg(
        F.count("*").alias("n_vectors"),
        F.count_if(~F.col("_sized")).alias("n_wrong_dimension"),
        F.count_if(~F.col("_finite")).alias("n_not_finite"),
        F.count_if(~F.col("_unit")).alias("n_not_unit"),
        F.round(F.avg("_norm"), 6).alias("norm_mean"),
        F.round(F.stddev_pop("_norm"), 6).alias("norm_std"),
    )
