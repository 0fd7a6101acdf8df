"""Running totals over sorted values, in many tasks even for one hot group."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 1_000_000
MOST_BUCKETS = 10_000


def running_totals(
    df: DataFrame,
    value: str,
    totals: list[str],
    by: list[str],
    descending: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Add ``cum_<t>`` for each column in ``totals``, over ``value`` within ``by``.

    The input holds one row per (by, value), values not NULL. They are cut into
    buckets at approximate quantiles; a window runs inside each (by, bucket)
    and the sums of the earlier buckets are added. The number of buckets
    follows the row count. Their bounds become constants of the plan, so a
    recomputed task buckets the same way. Pass a stored table: it is read
    several times.
    """
    if buckets is None:
        buckets = min(MOST_BUCKETS, df.count() // ROWS_PER_BUCKET + 1)
    if buckets > 1:
        probabilities = [i / buckets for i in range(1, buckets)]
        bounds = sorted(set(df.approxQuantile(value, probabilities, 0.25 / buckets)))
        bucketizer = Bucketizer(
            splits=[float("-inf"), *bounds, float("inf")],
            inputCol=value,
            outputCol="_raw_bucket",
            handleInvalid="keep",
        )
        sign = -1 if descending else 1
        placed = (
            bucketizer.transform(df)
            .withColumn("_bucket", (F.col("_raw_bucket") * sign).cast("int"))
            .drop("_raw_bucket")
        )
    else:
        placed = df.withColumn("_bucket", F.lit(0))
    ordered = F.col(value).desc() if descending else F.col(value).asc()
    inside = (
        Window.partitionBy(*by, "_bucket")
        .orderBy(ordered)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # At most ``buckets`` + 2 rows per group.
    earlier = (
        Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    keys = [*by, "_bucket"]
    starts = placed.groupBy(*keys).agg(*[F.sum(t).alias(f"_sum_{t}") for t in totals])
    starts = starts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[
            F.coalesce(F.sum(f"_sum_{t}").over(earlier), F.lit(0)).alias(f"_start_{t}")
            for t in totals
        ],
    )
    running = placed.select("*", *[F.sum(t).over(inside).alias(f"_run_{t}") for t in totals])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return running.join(starts, same).select(
        *df.columns,
        *[(F.col(f"_start_{t}") + F.col(f"_run_{t}")).alias(f"cum_{t}") for t in totals],
    )
