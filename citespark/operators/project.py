"""Dimensionality reduction: fit on a sample, apply to tables of any size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citespark.functions.vectors import SMALLEST_NORM, as_arrow, as_matrix
from citespark.operators.sampling import DEFAULT_SEED, sample_by_key


@dataclass(frozen=True)
class Projection:
    """Mean, component rows and the share of variance each component explains."""

    mean: np.ndarray
    components: np.ndarray
    explained: np.ndarray

    @property
    def output_dimension(self) -> int:
        return self.components.shape[0]

    @property
    def explained_variance(self) -> float:
        return round(float(self.explained.sum()), 6)


def fit_projection(
    df: DataFrame,
    id_column: str,
    input_dimension: int,
    output_dimension: int,
    fit_rows: int | None = None,
    seed: int = DEFAULT_SEED,
) -> Projection:
    """PCA of the embeddings, on a deterministic sample when ``fit_rows`` is given.

    Spark sums the covariance over the rows; only matrices of the vector
    dimension reach the driver.
    """
    if not 0 < output_dimension < input_dimension:
        raise ValueError("the output dimension must be positive and below the input dimension")
    if fit_rows is not None and fit_rows < output_dimension:
        raise ValueError("fitting needs at least as many rows as output dimensions")
    rows = df.select(id_column, "embedding")
    if fit_rows is not None:
        rows = sample_by_key(rows, id_column, fit_rows, seed)
    rows = rows.select(
        array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
    )
    found = rows.select(
        Summarizer.metrics("mean", "count").summary(F.col("features")).alias("s")
    ).first()["s"]
    if found["count"] < output_dimension:
        raise ValueError("fitting needs at least as many rows as output dimensions")
    mean = found["mean"].toArray()
    if len(mean) != input_dimension:
        raise ValueError(f"expected vectors of {input_dimension} numbers, found {len(mean)}")
    model = PCA(k=output_dimension, inputCol="features", outputCol="reduced").fit(rows)
    return Projection(
        mean, model.pc.toArray().T.copy(), model.explainedVariance.toArray().copy()
    )


def project(df: DataFrame, projection: Projection, column: str = "embedding") -> DataFrame:
    """Replace vectors by their unit-length projection; used for both sides.

    Spark's own PCA transform leaves the mean in, so the centring is done here
    with the stored mean.
    """
    input_dimension = projection.components.shape[1]
    components, mean = projection.components, projection.mean
    at = df.columns.index(column)
    schema = T.StructType(
        [
            T.StructField(f.name, T.ArrayType(T.FloatType()), True) if f.name == column else f
            for f in df.schema.fields
        ]
    )

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = as_matrix(batch.column(column), input_dimension).astype(np.float64)
            reduced = (rows - mean) @ components.T
            length = np.linalg.norm(reduced, axis=1, keepdims=True)
            if len(length) and length.min() <= SMALLEST_NORM:
                raise ValueError("a projected vector has no length")
            columns = list(batch.columns)
            columns[at] = as_arrow(reduced / length)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(reduce, schema)


def folding(input_dimension: int, output_dimension: int) -> Projection:
    """A fixed projection that sums neighbouring dimensions; nothing is fitted."""
    if output_dimension <= 0 or input_dimension % output_dimension:
        raise ValueError("the output dimension must divide the input dimension")
    group = input_dimension // output_dimension
    components = np.kron(np.eye(output_dimension), np.ones((1, group)))
    return Projection(np.zeros(input_dimension), components, np.zeros(output_dimension))


def save_projection(spark: SparkSession, projection: Projection, path: str) -> None:
    """Store the model as a small Parquet table, one row per component."""
    rows = [(-1, projection.mean.tolist(), 0.0)] + [
        (i, row.tolist(), float(projection.explained[i]))
        for i, row in enumerate(projection.components)
    ]
    schema = "component int, weights array<double>, explained double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)


def load_projection(spark: SparkSession, path: str) -> Projection:
    rows = spark.read.parquet(path).orderBy("component").collect()
    if not rows or rows[0].component != -1:
        raise ValueError(f"no projection is stored at {path}")
    return Projection(
        np.array(rows[0].weights),
        np.array([r.weights for r in rows[1:]]),
        np.array([r.explained for r in rows[1:]]),
    )
