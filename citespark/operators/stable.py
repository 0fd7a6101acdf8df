"""Helpers that make intermediate results stable and bound what is broadcast."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


SMALL_TABLE_BYTES = 256 << 20


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session
    without the setting gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
        return folder
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="citespark-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so a lost executor cannot change rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread_small_table(df: DataFrame) -> DataFrame:
    """Use all cores for costly per-row work on a small table.

    A Parquet row group is read by one task, so a small table may come in fewer
    tasks than there are cores. Catalyst's size estimate decides, with a fixed
    bound on what is shuffled; a larger table has row groups enough.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size <= SMALL_TABLE_BYTES else df


def run_once(model_udf):
    """Keep Catalyst from copying a costly Python call into an inferred filter.

    Exploding or filtering a result makes Spark derive further conditions on
    it, and each would call the model again for every row.
    """
    return model_udf.asNondeterministic()


def require_columns(df: DataFrame, columns: list[str], what: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns: {', '.join(missing)}")
