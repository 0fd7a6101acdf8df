"""Encode a table in runs: each run takes up the rows that have no vector yet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from citespark.operators.encode import TextEncoder, encode_texts, pending_rows


SETTINGS = "model string, dimension int, source string"


def stored_rows(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame | None:
    """The Parquet rows under a path. None if there is no folder; one without files is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def check_settings(
    spark: SparkSession, path: str, model_name: str, dimension: int, source: str | None = None
) -> None:
    """Store the settings of the run, or fail when an earlier run used others.

    A folder that a failed run left empty counts as no earlier run.
    """
    wanted = (model_name, dimension, source)
    stored = stored_rows(spark, path, SETTINGS)
    found = stored.first() if stored is not None else None
    if found is None:
        spark.createDataFrame([wanted], SETTINGS).write.mode("append").parquet(path)
    elif tuple(found) != wanted:
        raise ValueError(f"the output was encoded with {found}, not with {wanted}")


def vector_schema(rows: StructType, id_column: str) -> StructType:
    """Schema of an encoded table: the id as in ``rows``, and the vector."""
    return StructType([rows[id_column], StructField("embedding", ArrayType(FloatType()))])


def encode_pending(
    df: DataFrame,
    output: str,
    make_encoder: Callable[[], TextEncoder],
    model_name: str,
    dimension: int,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    batch_size: int = 256,
    source: str | None = None,
) -> DataFrame:
    """Append the vectors of rows not encoded before; returns the whole table.

    A run that fails leaves no part of its own output, and the next one starts
    from what is there, also after a first run that failed. ``source`` names
    the input; later runs must name the same.
    """
    spark = df.sparkSession
    check_settings(spark, f"{output}/settings", model_name, dimension, source)
    path = f"{output}/vectors"
    schema = vector_schema(df.schema, id_column)
    done = stored_rows(spark, path, schema)
    rows = df if done is None else pending_rows(df, done, id_column)
    vectors = encode_texts(rows, text_column, make_encoder, dimension, batch_size)
    vectors.select(id_column, "embedding").write.mode("append").option(
        "compression", "zstd"
    ).parquet(path)
    return spark.read.schema(schema).parquet(path)
