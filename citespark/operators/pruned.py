"""Exact top-k search that skips blocks which cannot hold a better document.

The angle between unit vectors obeys the triangle inequality: a document at the
angle r from its pivot is at least |a - r| from a query at the angle a from that
pivot. A first search of the nearest cells gives each query a score that k
documents reach; blocks of a cell whose best possible score is below it are
not scored. The result is that of the full search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.functions.vectors import UNIT_TOLERANCE, as_matrix
from citespark.operators.ann import cell_topk
from citespark.operators.search import (
    BROADCAST_BYTES,
    MARGIN,
    PARTIAL_SCHEMA,
    _batch,
    _BestK,
    best_per_query,
    check_unit_vectors,
)
from citespark.operators.stable import cut_lineage

#: Documents that are skipped or scored together.
BLOCK_ROWS = 64
#: Rounding of float32 angles, and lengths that may be off by the tolerance for unit vectors.
ANGLE_SLACK = 1e-3
LENGTH_SLACK = (1 + UNIT_TOLERANCE) ** 2 - 1


def angles(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angle between each vector and each pivot."""
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    products = vectors.astype(np.float64) @ pivots.astype(np.float64).T
    return np.arccos(np.clip(products / np.maximum(lengths, 1e-12), -1, 1))


def best_possible(angle: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Largest score of a query at ``angle`` from a pivot and documents ``low`` to ``high`` from it."""
    apart = np.maximum(0, np.maximum(angle - high, low - angle) - ANGLE_SLACK)
    cosine = np.cos(apart)
    return cosine + LENGTH_SLACK * np.abs(cosine)


def pruned_topk(
    queries: DataFrame,
    index: DataFrame,
    pivots: np.ndarray,
    k: int,
    nprobe: int = 1,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """Exact top k over ``index`` (from ``assign_cells``), and how much was scored.

    Returns the rankings (query_id, rank, doc_id, score) and one row
    (scored_pairs, all_pairs). Query ids must be unique. Queries are counted;
    with their bounds at most ``broadcast_bytes`` are in use at once, more are
    searched in parts, each of which reads the index. Cells need not hold k
    documents: a query without a bound is compared with everything.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    dimension = pivots.shape[1]
    pivots = pivots / np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-12)
    asked = check_unit_vectors(queries.select("query_id", "embedding"), dimension)
    near = cell_topk(asked, index, pivots, k, nprobe)
    bounds = near.filter(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    known = cut_lineage(asked.join(bounds, "query_id", "left"))
    size = dimension * 4 + 16
    parts = max(1, -(-known.count() * size // broadcast_bytes))
    partial = None
    for part in range(parts):
        mine = known
        if parts > 1:
            mine = known.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        found = _scored(mine.toArrow(), index, pivots, k)
        partial = found if partial is None else partial.unionByName(found)
    partial = cut_lineage(partial)
    counts = partial.filter("query_id IS NULL").agg(
        F.coalesce(F.sum("doc_id"), F.lit(0)).alias("scored_pairs"),
        F.coalesce(F.sum("score"), F.lit(0)).cast("bigint").alias("all_pairs"),
    )
    return best_per_query(partial.filter("query_id IS NOT NULL"), k), counts


def _scored(held: pa.Table, index: DataFrame, pivots: np.ndarray, k: int) -> DataFrame:
    dimension = pivots.shape[1]
    bound = held.column("bound").combine_chunks().fill_null(-np.inf)
    shared = index.sparkSession.sparkContext.broadcast(
        (
            held.column("query_id").to_numpy(),
            as_matrix(held.column("embedding"), dimension),
            bound.to_numpy(zero_copy_only=False),
        )
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix, floor = shared.value
        best = _BestK(names, matrix, k)
        best.floor = floor.copy()
        scored = every = 0
        to_pivot: dict[int, np.ndarray] = {}
        for batch in batches:
            cells = batch.column(0).to_numpy()
            docs = batch.column(1).to_numpy()
            vectors = as_matrix(batch.column(2), dimension, unit=True)
            every += len(docs) * len(names)
            order = np.argsort(cells, kind="stable")
            found, starts = np.unique(cells[order], return_index=True)
            for cell, here in zip(found.tolist(), np.split(order, starts[1:])):
                if cell not in to_pivot:
                    # Batches come cell by cell; only the open one is kept.
                    to_pivot = {cell: angles(matrix, pivots[cell : cell + 1])[:, 0]}
                own = angles(vectors[here], pivots[cell : cell + 1])[:, 0]
                by_angle = np.argsort(own, kind="stable")
                here, own = here[by_angle], own[by_angle]
                for at in range(0, len(here), BLOCK_ROWS):
                    block, ring = here[at : at + BLOCK_ROWS], own[at : at + BLOCK_ROWS]
                    most = best_possible(to_pivot[cell], ring[0], ring[-1])
                    rows = np.flatnonzero(most >= best.floor - MARGIN)
                    if len(rows):
                        best.add(docs[block], vectors[block], rows)
                        scored += len(rows) * len(block)
        yield _batch(*best.result())
        yield pa.record_batch(
            [pa.array([None], pa.int64()), pa.array([scored]), pa.array([float(every)])],
            names=["query_id", "doc_id", "score"],
        )

    return index.select("_cell", "doc_id", "embedding").mapInArrow(score, PARTIAL_SCHEMA)
