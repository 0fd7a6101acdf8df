"""Generated answers that are kept: a prompt is put to a model once, over all runs.

Answers are stored under a digest of model and prompt. A run asks only for the
digests that the store lacks, in parts of bounded size that are written one
after the other. A generator that fails costs the prompts it did not answer and
nothing else: what the tasks have answered is written before the run fails.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citespark.operators.answers import Generator
from citespark.operators.stable import cut_lineage

STORE = (
    "digest string, answer string, prompt_tokens bigint, output_tokens bigint, "
    "generation_ms double"
)
#: Prompts that are answered between two writes.
ROWS_PER_WRITE = 10_000


def prompt_digest(model_name: str, system: Column, user: Column) -> Column:
    """Digest of a prompt for a model; lengths keep the parts apart."""
    parts = [F.lit(model_name), F.coalesce(system, F.lit("")), F.coalesce(user, F.lit(""))]
    sized = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.sha2(F.concat(*sized), 256)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The answers at hand; none before the first run."""
    try:
        return spark.read.schema(STORE).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STORE)


def _answered(
    asked: DataFrame, make_generator: Callable[[], Generator], batch_size: int
) -> DataFrame:
    """Rows of :data:`STORE` and ``error``; a task stops asking at its first failure."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        generator, error = None, None
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for start in range(0, len(rows), batch_size):
                part = rows[start : start + batch_size]
                made: list = []
                began = time.perf_counter()
                if error is None:
                    try:
                        generator = generator or make_generator()
                        made = list(generator([(r["system"], r["user"]) for r in part]))
                        if len(made) != len(part):
                            raise ValueError(f"{len(part)} prompts got {len(made)} answers")
                    except Exception as failure:  # told to the driver, which fails the run
                        made, error = [], f"{type(failure).__name__}: {failure}"
                each = (time.perf_counter() - began) * 1000 / len(part)
                for i, row in enumerate(part):
                    answer = made[i] if made else None
                    out.append(
                        {
                            "digest": row["digest"],
                            "answer": str(getattr(answer, "text", answer)).strip() if made else None,
                            "prompt_tokens": getattr(answer, "prompt_tokens", None),
                            "output_tokens": getattr(answer, "output_tokens", None),
                            "generation_ms": each if made else None,
                            "error": None if made else error,
                        }
                    )
            yield pa.RecordBatch.from_pylist(out, schema=fields)

    fields = pa.schema(
        [
            ("digest", pa.string()),
            ("answer", pa.string()),
            ("prompt_tokens", pa.int64()),
            ("output_tokens", pa.int64()),
            ("generation_ms", pa.float64()),
            ("error", pa.string()),
        ]
    )
    return asked.mapInArrow(run, f"{STORE}, error string")


def answers_from_store(
    prompts: DataFrame,
    path: str,
    make_generator: Callable[[], Generator],
    model_name: str,
    batch_size: int = 8,
    rows_per_write: int = ROWS_PER_WRITE,
) -> DataFrame:
    """``prompts(digest, system, user)`` answered: the rows of :data:`STORE` for their digests.

    Equal prompts are asked once. After the run all digests are in the store, or
    the run fails with the first error and the next one goes on.
    """
    spark = prompts.sparkSession
    wanted = cut_lineage(prompts.select("digest", "system", "user").dropDuplicates(["digest"]))
    pending = cut_lineage(
        wanted.join(read_store(spark, path).select("digest"), "digest", "left_anti")
    )
    parts = -(-pending.count() // rows_per_write)
    for part in range(parts):
        mine = pending
        if parts > 1:
            mine = pending.filter(F.pmod(F.xxhash64("digest"), F.lit(parts)) == part)
        # Stored before it is divided, so that no prompt is put twice.
        found = cut_lineage(_answered(mine, make_generator, batch_size))
        good = found.filter("error IS NULL").drop("error")
        good.write.mode("append").option("compression", "zstd").parquet(path)
        bad = found.filter("error IS NOT NULL")
        failed = bad.count()
        if failed:
            raise RuntimeError(f"{failed} prompts were not answered: {bad.first()['error']}")
    return read_store(spark, path).join(wanted.select("digest"), "digest", "left_semi")
