"""Table reads with a schema check, and sinks for corpora and run results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from citespark.operators.stable import require_columns


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Read only the named columns of a Parquet table; all must be there."""
    table = spark.read.parquet(path)
    require_columns(table, columns, path)
    rows = table.select(*columns)
    if rows.isEmpty():
        raise ValueError(f"{path} holds no rows")
    return rows


def write_corpus(corpus: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write a corpus as ZSTD Parquet in ``doc_id`` order.

    An existing table is kept unless ``overwrite`` is set. Then the new one is
    written beside it and takes its place by renaming, so a job that fails at
    any time leaves the old table or the new one, whole.
    """
    draft = f"{path.rstrip('/')}.draft-{uuid.uuid4().hex}" if overwrite else path
    (
        corpus.repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id")
        .write.mode("errorifexists")
        .option("compression", "zstd")
        .parquet(draft)
    )
    if overwrite:
        _swap(corpus.sparkSession, draft, path)


def _swap(spark: SparkSession, draft: str, path: str) -> None:
    """Put ``draft`` in the place of ``path`` on Spark's file system."""
    new_path = spark._jvm.org.apache.hadoop.fs.Path
    source, target = new_path(draft), new_path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    old = new_path(f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")
    kept = system.exists(target)
    if kept and not system.rename(target, old):
        raise OSError(f"{path} cannot be renamed")
    if not system.rename(source, target):
        if kept:
            system.rename(old, target)
        raise OSError(f"{draft} cannot be renamed")
    if kept:
        system.delete(old, True)


def write_metrics_csv(metrics: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write per-query metrics or a comparison table as CSV with a header."""
    mode = "overwrite" if overwrite else "errorifexists"
    metrics.write.mode(mode).option("header", True).csv(path)


def write_run_json(summary: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write the one-row summary of a run, such as a manifest, as JSON."""
    mode = "overwrite" if overwrite else "errorifexists"
    summary.write.mode(mode).json(path)
