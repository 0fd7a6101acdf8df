"""Near-duplicate vectors by Euclidean p-stable hashing.

A table rounds several random projections of the unit vector to a grid; equal
roundings share a bucket. Vectors of a bucket are compared by exact cosine in
double precision. Equal vectors are one class and are compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.llm.staging import (
    components,
    group_bounds,
    join_counted,
    stored,
    whole_groups,
)

MIN_COSINE = 0.93
TABLES = 24
PROJECTIONS = 12
#: Grid width. Unit vectors at cosine 0.93 are 0.374 apart.
WIDTH = 2.0
#: Rows of a bucket that one group holds; larger buckets are compared in pairs of blocks.
BLOCK = 1_024
LEAF = "<f8"


def checked(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, vector in double precision, and whether the vector can link."""
    rows = vectors.select(
        F.col(id_col).alias("vec_id"),
        F.col(label_col).alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.withColumn(
        "can_link",
        F.col("label").isNotNull()
        & F.coalesce(finite, F.lit(False))
        & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False)),
    )


class Projections:
    """Seeded random projections, the same in every task."""

    def __init__(self, size: int, tables: int, projections: int, width: float, seed: int):
        draw = np.random.default_rng([seed, size])
        self.shape = (tables, projections)
        self.directions = draw.standard_normal((size, tables * projections))
        self.offsets = draw.uniform(0, width, tables * projections)
        self.factors = draw.integers(1, 1 << 63, tables * projections, dtype=np.uint64) | np.uint64(1)
        self.width = width

    def buckets(self, units: np.ndarray) -> np.ndarray:
        """A 64-bit bucket number per vector and table."""
        grid = np.floor((units @ self.directions + self.offsets) / self.width).astype(np.int64)
        mixed = (grid.view(np.uint64) + np.uint64(1 << 20)) * self.factors
        mixed ^= mixed >> np.uint64(31)
        total = mixed.reshape(len(units), *self.shape).sum(axis=2, dtype=np.uint64)
        total ^= total >> np.uint64(29)
        return (total * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def normalised(rows: list[list[float]]) -> np.ndarray:
    """Unit vectors in double precision, scaled first so that no square overflows."""
    matrix = np.array(rows, dtype=np.float64)
    matrix /= np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    min_cosine: float = MIN_COSINE,
    tables: int = TABLES,
    projections: int = PROJECTIONS,
    width: float = WIDTH,
    seed: int = 3,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors with equal, non-null labels and a cosine of at least ``min_cosine``
    link if some table has them in one bucket. Vectors that are null, zero or
    of non-finite components, or with a null label, link with nothing; so do
    vectors of different length. ``component_id`` is the smallest id reachable;
    a null id is never the smallest, unless there is no other. Rows that repeat
    an id are vectors of their own. An empty table gives an empty result, other
    columns are ignored.

    Classes of equal vectors travel once per table with their weight, so copies
    cost nothing. Buckets above :data:`BLOCK` classes are split into pairs of
    blocks; a pair of vectors counts in the first table that has it. Links
    never leave a task: it sends counts and a spanning forest.
    """
    rows = checked(vectors, id_col, vector_col, label_col)
    valid = rows.filter("can_link")
    classes = stored(
        valid.groupBy("label", "vector")
        .agg(F.min("vec_id").alias("class_id"), F.count("*").alias("n"))
        .withColumn("class_key", F.monotonically_increasing_id()),
        "classes",
    )

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Projections] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1_000):
                batch = whole.slice(at, 1_000)
                rows = batch.column(1).to_pylist()
                lengths = np.array([len(r) for r in rows])
                for size in np.unique(lengths).tolist():
                    part = np.flatnonzero(lengths == size)
                    units = normalised([rows[i] for i in part])
                    if size not in known:
                        known[size] = Projections(size, tables, projections, width, seed)
                    keys = known[size].buckets(units)
                    yield pa.record_batch(
                        [
                            batch.column(0).take(pa.array(part)),
                            pa.array([u.astype(LEAF).tobytes() for u in units], pa.binary()),
                            pa.array(list(keys), pa.list_(pa.int64())),
                        ],
                        names=["class_key", "unit", "buckets"],
                    )

    hashed = stored(
        classes.select("class_key", "vector").mapInArrow(
            hash_rows, "class_key bigint, unit binary, buckets array<bigint>"
        ).join(classes.select("class_key", "label", "class_id", "n"), "class_key"),
        "hashed",
    )
    placed = hashed.select(
        "class_key",
        F.posexplode("buckets").alias("at", "bucket"),
        F.xxhash64("label", F.length("unit")).alias("kind"),
    ).select("class_key", F.xxhash64("kind", "at", "bucket").alias("bucket"), "at")
    # Buckets of one class have nothing to compare.
    sizes = stored(
        placed.groupBy("bucket").agg(F.count("*").alias("in_bucket")).filter("in_bucket > 1"),
        "buckets",
    )
    entries = placed.count()
    shared = join_counted(placed, sizes, "bucket", "in_bucket", entries, "inner")
    blocks = F.ceil(F.col("in_bucket") / BLOCK)
    block = F.pmod(F.xxhash64("class_key", F.lit(seed)), blocks)
    # A row goes to each pair of blocks that has its own.
    dealt = shared.withColumn("blocks", blocks).withColumn("block", block).select(
        "class_key",
        "bucket",
        "at",
        "block",
        F.explode(
            F.transform(
                F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1),
                lambda other: F.struct(
                    F.least("block", other).alias("a"), F.greatest("block", other).alias("b")
                ),
            )
        ).alias("pair"),
    ).select(
        "class_key", "at", "block", F.xxhash64("bucket", "pair.a", "pair.b").alias("task"),
        (F.col("pair.a") == F.col("pair.b")).alias("same"),
    )
    compared = (
        dealt.join(hashed.drop("label"), "class_key")
        .select("task", "class_key", "class_id", "n", "at", "block", "same", "unit", "buckets")
        .repartition("task").sortWithinPartitions("task", "class_key")
        .mapInArrow(
            lambda batches: _compare(batches, min_cosine), "class_key bigint, other bigint, n bigint"
        )
    )
    compared = stored(compared, "links")
    counts = compared.groupBy("class_key").agg(F.sum("n").alias("others"))
    edges = compared.filter(F.col("other").isNotNull()).select("class_key", "other")
    found = components(edges, "class_key", "other")
    grouped = (
        classes.select("class_key", "label", "vector", "class_id", F.col("n").alias("copies"))
        .join(counts, "class_key", "left")
        .join(found.withColumnRenamed("node", "class_key"), "class_key", "left")
        .withColumn("component", F.coalesce("component", "class_key"))
    )
    grouped = stored(grouped, "grouped")
    least = grouped.groupBy("component").agg(
        F.min("class_id").alias("component_id"), F.count("*").alias("class_count")
    )
    total = grouped.count()
    named = stored(
        join_counted(grouped, least, "component", "class_count", total).select(
            F.struct("label", "vector").alias("class"),
            "copies",
            (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"),
            "component_id",
        ),
        "named",
    )
    members = valid.select("vec_id", F.struct("label", "vector").alias("class"))
    linked = join_counted(members, named, "class", "copies", valid.count()).select(
        "vec_id", "links", "component_id"
    )
    alone = rows.filter(~F.col("can_link")).select(
        "vec_id", F.lit(0).cast("bigint").alias("links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).select(
        "vec_id",
        F.col("links").cast("bigint").alias("n_links"),
        "component_id",
        F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def _compare(batches: Iterator[pa.RecordBatch], min_cosine: float) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, ["task"]):
        table = table.combine_chunks()
        task = table["task"].to_numpy()
        key, weight = table["class_key"].to_numpy(), table["n"].to_numpy()
        at, block = table["at"].to_numpy(), table["block"].to_numpy()
        same = table["same"].to_numpy()
        units, buckets = table["unit"], table["buckets"]
        starts, ends = group_bounds([task])
        keys, others, links = [], [], []
        for first, end in zip(starts.tolist(), ends.tolist(), strict=True):
            n = end - first
            if n < 2:
                continue
            matrix = np.stack(
                [np.frombuffer(u.as_buffer(), dtype=LEAF) for u in units[first:end]]
            )
            near = matrix @ matrix.T >= min_cosine
            near = np.triu(near, 1)
            if not same[first]:
                near &= block[first:end][:, None] != block[first:end][None, :]
            if at[first] and near.any():
                # A pair of an earlier table has been counted there.
                codes = np.array(buckets[first:end].to_pylist(), dtype=np.int64)[:, : at[first]]
                i, j = np.nonzero(near)
                near[i, j] = ~(codes[i] == codes[j]).any(axis=1)
            if not near.any():
                continue
            both = near | near.T
            own = key[first:end]
            keys.append(own)
            links.append(both @ weight[first:end])
            others.append(_forest(near, own))
        if keys:
            keys, links, others = map(np.concatenate, (keys, links, others))
            some = links > 0
            yield pa.record_batch(
                [
                    pa.array(keys[some], pa.int64()),
                    pa.array(others[some], pa.int64()),
                    pa.array(links[some], pa.int64()),
                ],
                names=["class_key", "other", "n"],
            )


def _forest(near: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each row the smallest key of its component in this group."""
    root = np.arange(len(keys))
    both = near | near.T | np.eye(len(keys), dtype=bool)
    while True:
        least = np.where(both, root[None, :], len(keys)).min(axis=1)
        least = least[least]
        if (least == root).all():
            return keys[root]
        root = least
