"""Joins to a table with unique keys that stay even when one key is hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.operators.stable import cut_lineage

ROWS_PER_COPY = 200_000


def rows_per_key(many: DataFrame, key: str) -> DataFrame:
    """Keys with their number of ``_rows``, stored for several uses."""
    return cut_lineage(many.groupBy(key).agg(F.count("*").alias("_rows")))


def join_to_unique(
    many: DataFrame,
    one: DataFrame,
    key: str,
    how: str = "inner",
    rows_per_copy: int = ROWS_PER_COPY,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Join ``many`` to ``one``, which has one row per key.

    AQE splits skewed partitions by their compressed bytes, and equal keys
    compress so well that it may not see them. Here keys are counted. A key
    with more than ``rows_per_copy`` rows gets its row in ``one`` copied, and
    its rows in ``many`` are dealt out over the copies. Without such a key the
    join is a plain one. Pass ``many`` as a table or scan: it is read for the
    ``counts`` too, unless those of :func:`rows_per_key` are at hand.
    """
    if counts is None:
        counts = rows_per_key(many, key)
    # At most rows / rows_per_copy keys, so the broadcasts below are bounded.
    hot = counts.filter((F.col("_rows") > rows_per_copy) & F.col(key).isNotNull()).select(
        key, F.ceil(F.col("_rows") / rows_per_copy).alias("_copies")
    )
    if hot.isEmpty():
        return many.join(one, key, how)
    copies = F.coalesce("_copies", F.lit(1))
    dealt = (
        many.join(F.broadcast(hot), key, "left")
        .withColumn("_copy", F.pmod(F.monotonically_increasing_id(), copies))
        .drop("_copies")
    )
    copied = (
        one.join(F.broadcast(hot), key, "left")
        .withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1)))
        .drop("_copies")
    )
    return dealt.join(copied, [key, "_copy"], how).drop("_copy")
