"""Incremental encoding: a file stream that encodes each new file once.

The stream's checkpoint replaces a hand-kept progress file. A run that fails
resumes where it stopped, and a later run takes up only files added since.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from citespark.operators.encode import TextEncoder, encoded
from citespark.plans.encode_table import check_settings, stored_rows, vector_schema


def encode_new_files(
    spark: SparkSession,
    source: str,
    schema: StructType,
    output: str,
    make_encoder: Callable[[], TextEncoder],
    model_name: str,
    dimension: int,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    file_pattern: str = "*.parquet",
    batch_size: int = 256,
    files_per_trigger: int = 1000,
) -> DataFrame:
    """Encode the files not seen before, then return the whole encoded table."""
    check_settings(spark, f"{output}/settings", model_name, dimension, source)
    rows = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", file_pattern)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(source)
    )
    vectors = rows.select(
        id_column,
        encoded(F.col(text_column), make_encoder, dimension, batch_size).alias("embedding"),
    )
    query = (
        vectors.writeStream.format("parquet")
        .option("path", f"{output}/vectors")
        .option("checkpointLocation", f"{output}/progress")
        .option("compression", "zstd")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    encoded_schema = vector_schema(schema, id_column)
    found = stored_rows(spark, f"{output}/vectors", encoded_schema)
    # Without a file to encode the stream writes no folder.
    return found if found is not None else spark.createDataFrame([], encoded_schema)
