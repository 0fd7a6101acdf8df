"""Raw float32 matrices: fixed-size records without a header, row number = id.

Files are read and written through ``pyarrow.fs``, on the file system that Spark
resolves the path to: local, ``hdfs://`` or ``s3a://``. Tasks read byte ranges; no file is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citespark.functions.vectors import as_arrow, as_matrix

ROWS_PER_READ = 8_192
ROWS_PER_TASK = 262_144


SUCCESS = "_SUCCESS"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark itself would resolve it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(hadoop).toString()


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """File system and inner path of a qualified path."""
    scheme, colon, rest = path.partition(":")
    if colon and scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    if scheme in ("s3a", "s3n"):
        path = f"s3:{rest}"
    return fs.FileSystem.from_uri(path)


def _files(path: str) -> list[tuple[str, int]]:
    """Matrix files at a path, in name order, with their sizes."""
    system, inner = _open(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(info.path, info.size)]
    listed = system.get_file_info(fs.FileSelector(inner))
    if not any(i.base_name == SUCCESS for i in listed):
        raise ValueError(f"{path} was not written to its end: it has no {SUCCESS} file")
    return sorted(
        (i.path, i.size)
        for i in listed
        if i.type == fs.FileType.File and i.base_name.endswith(".f32")
    )


def matrix_rows(spark: SparkSession, path: str, dimension: int) -> int:
    """Number of vectors, from the file sizes; a partial record is an error."""
    if dimension <= 0:
        raise ValueError("the dimension must be positive")
    path = qualified(spark, path)
    files = _files(path)
    record = dimension * 4
    if not files or all(size == 0 for _, size in files):
        raise ValueError(f"{path} holds no vectors")
    for name, size in files:
        if size % record:
            raise ValueError(f"{name} is not a whole number of {record}-byte records")
    return sum(size for _, size in files) // record


def read_matrix(spark: SparkSession, path: str, dimension: int) -> DataFrame:
    """Read ``(doc_id, embedding)`` from a matrix file or a folder of parts."""
    matrix_rows(spark, path, dimension)
    path = qualified(spark, path)
    record = dimension * 4
    starts, first = [], 0
    for name, size in _files(path):
        rows = size // record
        for offset in range(0, rows, ROWS_PER_TASK):
            starts.append((name, offset, min(ROWS_PER_TASK, rows - offset), first + offset))
        first += rows
    ranges = spark.createDataFrame(
        starts, "file string, offset bigint, n_rows bigint, first_id bigint"
    ).repartition(len(starts))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _open(path)
        for batch in batches:
            for piece in batch.to_pylist():
                with system.open_input_file(piece["file"]) as source:
                    for at in range(0, piece["n_rows"], ROWS_PER_READ):
                        n = min(ROWS_PER_READ, piece["n_rows"] - at)
                        raw = source.read_at(n * record, (piece["offset"] + at) * record)
                        vectors = np.frombuffer(raw, dtype="<f4").reshape(n, dimension)
                        ids = np.arange(n, dtype=np.int64) + piece["first_id"] + at
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids), as_arrow(vectors)], names=["doc_id", "embedding"]
                        )

    return ranges.mapInArrow(read, "doc_id bigint, embedding array<float>")


def write_matrix(df: DataFrame, path: str, dimension: int) -> None:
    """Write vectors in ``doc_id`` order as a folder of ``part-*.f32`` files.

    Part names follow the range partitions, so reading the parts by name gives
    the order back. A repeated task overwrites its own part. A folder counts as
    written only with the success file that ends the job.
    """
    path = qualified(df.sparkSession, path)
    system, inner = _open(path)
    if system.get_file_info(inner).type != fs.FileType.NotFound:
        raise FileExistsError(path)
    system.create_dir(inner, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        target, folder = _open(path)
        final = f"{folder}/part-{task.partitionId():010d}.f32"
        draft = f"{folder}/.part-{task.partitionId():010d}.{task.taskAttemptId()}"
        n = 0
        with target.open_output_stream(draft) as sink:
            for batch in batches:
                rows = as_matrix(batch.column("embedding"), dimension)
                sink.write(rows.astype("<f4").tobytes())
                n += len(rows)
        target.move(draft, final)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n_rows"])

    ordered = df.select("doc_id", "embedding").repartitionByRange("doc_id")
    written = ordered.sortWithinPartitions("doc_id").mapInArrow(write, "n_rows bigint")
    written.agg(F.sum("n_rows")).collect()
    with system.open_output_stream(f"{inner}/{SUCCESS}"):
        pass
