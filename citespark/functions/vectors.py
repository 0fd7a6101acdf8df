"""Vector expressions over ``ARRAY<FLOAT>`` columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SMALLEST_NORM = 1e-12
# |norm - 1| may be 1e-3 absolute plus 1e-5 relative to the expected length.
UNIT_TOLERANCE = 1e-3 + 1e-5


def norm(vector: Column) -> Column:
    squares = F.aggregate(
        vector,
        F.lit(0.0),
        lambda total, x: total + x.cast("double") * x.cast("double"),
    )
    return F.sqrt(squares)


def l2_normalize(vector: Column) -> Column:
    """Unit-length copy of the vector; a (near) zero vector fails the job."""
    length = norm(vector)
    scaled = F.transform(vector, lambda x: (x.cast("double") / length).cast("float"))
    return F.when(length > SMALLEST_NORM, scaled).otherwise(
        F.raise_error(F.lit("cannot normalise a zero-length or non-finite vector"))
    )


def is_finite(vector: Column) -> Column:
    return F.forall(
        vector,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))),
    )


def is_unit(vector: Column) -> Column:
    return F.abs(norm(vector) - 1.0) <= UNIT_TOLERANCE


def as_matrix(
    vectors: pa.Array | pa.ChunkedArray, dimension: int, unit: bool = False
) -> np.ndarray:
    """Rows of an Arrow list column as a float32 matrix, without Python objects.

    Gaps, a wrong dimension and numbers that are not finite are errors; with
    ``unit`` so is any length but one.
    """
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten()
    if vectors.null_count or flat.null_count or len(flat) != len(vectors) * dimension:
        raise ValueError(f"expected vectors of {dimension} numbers without gaps")
    matrix = flat.to_numpy(zero_copy_only=False).reshape(-1, dimension)
    matrix = matrix.astype(np.float32, copy=False)
    if not np.isfinite(matrix).all():
        raise ValueError("vectors must be finite")
    if unit and len(matrix):
        if np.abs(np.linalg.norm(matrix, axis=1) - 1.0).max() > UNIT_TOLERANCE:
            raise ValueError("vectors must be of unit length")
    return matrix


def as_arrow(matrix: np.ndarray) -> pa.ListArray:
    """Matrix rows as an Arrow ``list<float>`` column."""
    rows, dimension = matrix.shape
    offsets = np.arange(rows + 1, dtype=np.int32) * dimension
    return pa.ListArray.from_arrays(
        pa.array(offsets), pa.array(np.ascontiguousarray(matrix, dtype=np.float32).ravel())
    )
