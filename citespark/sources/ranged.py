"""A table stored in ranges of its ids, for look-ups that read few files.

Each range is a partition folder, and a small table beside them has the first
and last id of every range. A look-up finds the ranges of its ids there and
joins on the partition column, so Spark prunes all other folders at run time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from citespark.operators.stable import cut_lineage, run_once
from citespark.sources.snapshot import current, new_version, publish

ROWS_PER_RANGE = 100_000
#: Ids of a look-up that are broadcast; more are joined by a shuffle, on the range too.
BROADCAST_IDS = 2_000_000


@dataclass(frozen=True)
class RangedTable:
    """``rows`` with the partition column ``_range``; first and last id of each range."""

    rows: DataFrame
    first: np.ndarray
    last: np.ndarray
    number: np.ndarray
    id_column: str

    @property
    def columns(self) -> list[str]:
        return [c for c in self.rows.columns if c != "_range"]

    def look_up(self, ids: DataFrame, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
        """Rows whose id is in ``ids``, from the files of their ranges only."""
        first, last, number = self.first, self.last, self.number

        @F.arrow_udf("int")
        def place(keys: pa.Array) -> pa.Array:
            keys = keys.to_numpy(zero_copy_only=False)
            at = np.searchsorted(last, keys)
            inside = at < len(last)
            inside[inside] = first[at[inside]] <= keys[inside]
            found = np.full(len(keys), -1, dtype=np.int32)
            found[inside] = number[at[inside]]
            return pa.array(found)

        key = F.col(self.id_column).cast("bigint")
        wanted = ids.filter(key.isNotNull()).select(key.alias(self.id_column)).distinct()
        # Stored: Spark prunes partitions by a plain filtered table, not through a Python call.
        placed = cut_lineage(wanted.withColumn("_range", run_once(place)(self.id_column)))
        few = placed.count() <= broadcast_ids
        # Ids that no range holds have no place and need no file.
        placed = placed.filter("_range >= 0")
        if few:
            placed = F.broadcast(placed)
        return self.rows.join(placed, ["_range", self.id_column], "left_semi").drop("_range")


def write_ranged(
    table: DataFrame,
    path: str,
    id_column: str = "doc_id",
    rows_per_range: int = ROWS_PER_RANGE,
) -> RangedTable:
    """Store ``table`` in ranges of its integer ids and publish it at ``path``.

    Ids must not be null. Rows that repeat an id are kept, all in one range: a
    range ends only where the id changes.
    """
    spark = table.sparkSession
    if not table.filter(F.col(id_column).isNull()).isEmpty():
        raise ValueError(f"{id_column} must not be null")
    ranges = max(1, -(-table.count() // rows_per_range))
    version = new_version(path)
    # An empty table has no file to tell its columns.
    schema = StructType([*table.schema.fields, StructField("_range", IntegerType())])
    (
        table.repartitionByRange(ranges, id_column)
        .sortWithinPartitions(id_column)
        .withColumn("_range", F.spark_partition_id())
        .write.option("compression", "zstd").partitionBy("_range").parquet(f"{version}/rows")
    )
    (
        spark.read.schema(schema).parquet(f"{version}/rows").groupBy("_range")
        .agg(F.min(id_column).cast("bigint").alias("first"),
             F.max(id_column).cast("bigint").alias("last"))
        .coalesce(1).write.parquet(f"{version}/ranges")
    )
    publish(spark, path, version, {"id_column": id_column, "schema": schema.jsonValue()})
    return open_ranged(spark, path)


def open_ranged(spark: SparkSession, path: str) -> RangedTable:
    """The published table at ``path``; one row per range is collected."""
    version, about = current(spark, path)
    found = spark.read.parquet(f"{version}/ranges").orderBy("first").collect()
    return RangedTable(
        spark.read.schema(StructType.fromJson(about["schema"])).parquet(f"{version}/rows"),
        np.array([r["first"] for r in found], dtype=np.int64),
        np.array([r["last"] for r in found], dtype=np.int64),
        np.array([r["_range"] for r in found], dtype=np.int32),
        about["id_column"],
    )
