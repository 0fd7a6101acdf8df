"""Deterministic samples and dense row numbers.

Sampling orders rows by a multiplicative key of their id. The key is spread
evenly over a known range, so small histograms of it find the cut for any
sample size without sorting the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citespark.operators.stable import cut_lineage

# Multiplier and modulus of the sampling key, default seed.
KEY_MULTIPLIER = 1103515245
KEY_MODULUS = 2147483647
DEFAULT_SEED = 20260714

KEY_BUCKETS = 4096


def sampling_key(row_id: Column, seed: int = DEFAULT_SEED) -> Column:
    """``(id * multiplier + seed) % modulus``, for ids of any size.

    For ids from 0 on the id is reduced first, so that no product overflows.
    The remainder of a negative product keeps its sign, so negative ids are
    multiplied as decimals.
    """
    modulus = F.lit(KEY_MODULUS).cast("bigint")
    row_id = row_id.cast("bigint")
    reduced = (row_id % modulus) * F.lit(KEY_MULTIPLIER).cast("bigint")
    exact = row_id.cast("decimal(20,0)") * F.lit(KEY_MULTIPLIER).cast("decimal(10,0)")
    negative = (exact + F.lit(seed)) % F.lit(KEY_MODULUS).cast("decimal(10,0)")
    return F.when(
        row_id >= 0, (reduced + F.lit(seed).cast("bigint")) % modulus
    ).otherwise(negative.cast("bigint"))


@dataclass(frozen=True)
class KeyCut:
    """Where a sample ends: the key of its last row and the rows with smaller keys."""

    key: int
    rows_before: int


def find_cut(ids: DataFrame, id_column: str, n: int, seed: int = DEFAULT_SEED) -> KeyCut:
    """Locate the n-th smallest key.

    A histogram of at most KEY_BUCKETS rows finds the bucket of the cut, one
    inside that bucket the next, down to a single key.
    """
    if n <= 0:
        raise ValueError("the sample size must be positive")
    keys = ids.select(sampling_key(F.col(id_column), seed).alias("_key"))
    low, size, before = -KEY_MODULUS, 2 * KEY_MODULUS + 1, 0
    while size > 1:
        width = -(-size // KEY_BUCKETS)
        histogram = (
            keys.filter(F.col("_key").between(low, low + size - 1))
            .groupBy(F.floor((F.col("_key") - low) / width).cast("int").alias("_bucket"))
            .count()
            .orderBy("_bucket")
            .collect()
        )
        for row in histogram:
            if before + row["count"] >= n:
                low, size = low + row["_bucket"] * width, width
                break
            before += row["count"]
        else:
            raise ValueError(f"asked for {n} rows, only {before} are there")
    return KeyCut(low, before)


def up_to_cut(df: DataFrame, id_column: str, cut: KeyCut, seed: int = DEFAULT_SEED) -> DataFrame:
    """Rows that may be in the sample: a superset that ends with the cut's key."""
    return df.filter(sampling_key(F.col(id_column), seed) <= cut.key)


def sample_by_key(
    df: DataFrame,
    id_column: str,
    n: int,
    seed: int = DEFAULT_SEED,
    cut: KeyCut | None = None,
) -> DataFrame:
    """Exactly ``n`` rows: those with the smallest (key, id).

    Keys below the cut are kept by a filter. Only the rows whose key is that of
    the cut are ordered; these are ids that differ by multiples of the modulus.
    """
    cut = cut or find_cut(df, id_column, n, seed)
    keyed = df.withColumn("_key", sampling_key(F.col(id_column), seed))
    kept = keyed.filter(F.col("_key") < cut.key)
    edge = (
        keyed.filter(F.col("_key") == cut.key).orderBy(id_column).limit(n - cut.rows_before)
    )
    return kept.unionByName(edge).drop("_key")


def linspace_rows(
    df: DataFrame, id_column: str, n_rows: int, maximum: int = 10_000
) -> DataFrame:
    """Evenly spaced rows of a table whose ids are 0..n_rows-1.

    A row is kept when some j gives trunc(j * step) = id. That is decided from
    the id alone, so the sample is a filter and not a join.
    """
    if maximum <= 0 or n_rows <= 0:
        raise ValueError("row counts must be positive")
    m = min(maximum, n_rows)
    row_id = F.col(id_column)
    if m == n_rows:
        return df
    if m == 1:
        return df.filter(row_id == 0)
    step = F.lit((n_rows - 1) / (m - 1))
    near = F.round(row_id / step)
    hits = F.lit(False)
    for shift in (-1.0, 0.0, 1.0):
        j = near + F.lit(shift)
        at = F.when(j == m - 1, F.lit(n_rows - 1)).otherwise(F.floor(j * step))
        hits = hits | (j.between(0, m - 1) & (at == row_id))
    return df.filter(hits)


def dense_row_id(
    df: DataFrame,
    id_column: str,
    seed: int = DEFAULT_SEED,
    name: str = "doc_id",
    stored: bool = False,
) -> DataFrame:
    """Number all rows 0..n-1 in (key, id) order without a one-task window.

    Only the sort key is range-partitioned and numbered inside each partition;
    every partition then adds the row counts of those before it, and the number
    goes back to its row by the unique ``_uid``. That also ends the sort key, so
    a group of equal ids, even of exact copies, is split over partitions like
    any other rows. The numbers are checkpointed: range bounds come from a
    sample and must not be drawn again after a loss. So is the input, whose
    ``_uid`` must not change either, unless it is ``stored``: a plain scan of
    files or a checkpoint, read in a fixed order.
    """
    columns = df.columns
    rows = df.withColumn("_uid", F.monotonically_increasing_id())
    if not stored:
        rows = cut_lineage(rows)
    order = ["_key", "_id", "_tie", "_uid"]
    keyed = rows.select(
        sampling_key(F.col(id_column), seed).alias("_key"),
        F.col(id_column).alias("_id"),
        F.xxhash64(*columns).alias("_tie"),
        "_uid",
    )
    placed = cut_lineage(
        keyed.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("_uid", F.monotonically_increasing_id().alias("_place"))
    ).withColumn("_part", F.shiftright("_place", 33))
    # One row per partition, so this window and the broadcast stay small.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    numbers = placed.join(F.broadcast(starts), "_part").select(
        "_uid", (F.col("_start") + inside).alias(name)
    )
    return rows.join(numbers, "_uid").select(name, *columns)


def contiguity(df: DataFrame, id_column: str) -> DataFrame:
    """One row telling whether the ids are exactly 0..n-1.

    Counting per id first keeps the exact distinct count distributed.
    """
    per_id = df.groupBy(F.col(id_column).alias("_id")).agg(F.count("*").alias("_copies"))
    return per_id.agg(
        F.sum("_copies").alias("n_rows"),
        F.count("_id").alias("n_distinct"),
        F.min("_id").alias("min_id"),
        F.max("_id").alias("max_id"),
    ).withColumn(
        "contiguous",
        F.coalesce(
            (F.col("min_id") == 0)
            & (F.col("max_id") == F.col("n_rows") - 1)
            & (F.col("n_distinct") == F.col("n_rows")),
            F.lit(False),
        ),
    )
