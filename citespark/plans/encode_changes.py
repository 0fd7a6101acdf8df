"""Encoded tables that follow their source: new, changed and removed texts.

Each vector is stored with the SHA-256 of its text. A run compares the digests
of the source with those at hand, encodes what is new or changed, and publishes
a version that adds two small things to the last one: the new vectors, and the
ids whose older vectors no longer count. Vectors that stay are neither read nor
written. :func:`compact` puts all into one run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from citespark.operators.encode import TextEncoder, encode_texts
from citespark.operators.stable import cut_lineage
from citespark.sources.snapshot import current, new_version, publish

#: Ids out of date that are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
COUNTS = ("added", "changed", "removed", "kept")


def text_digest(column: str):
    """Digest of a text; a null counts as the empty one, as for encoders."""
    return F.sha2(F.coalesce(F.col(column), F.lit("")), 256)


def _published(spark: SparkSession, path: str) -> dict | None:
    try:
        return current(spark, path)[1]
    except FileNotFoundError:
        return None


def _valid(spark: SparkSession, path: str, about: dict, columns: list[str]) -> DataFrame | None:
    """Rows of all runs but those that a later run put out of date."""
    if not about["runs"]:
        return None
    key = about["id_column"]
    schema = StructType.fromJson(about["schema"])
    base = path.rstrip("/")
    rows = stale = None
    stale_ids = 0
    for number, run in enumerate(about["runs"]):
        vectors = spark.read.schema(schema).parquet(f"{base}/{run['folder']}/vectors")
        vectors = vectors.select(*columns, F.lit(number).alias("_run"))
        rows = vectors if rows is None else rows.unionByName(vectors)
        gone = run["changed"] + run["removed"]
        if gone:
            ids = spark.read.parquet(f"{base}/{run['folder']}/stale")
            ids = ids.select(F.col(key).alias("_stale_id"), F.lit(number).alias("_stale_run"))
            stale = ids if stale is None else stale.unionByName(ids)
            stale_ids += gone
    if stale is not None:
        if stale_ids <= BROADCAST_IDS:
            stale = F.broadcast(stale)
        older = (F.col(key) == F.col("_stale_id")) & (F.col("_run") < F.col("_stale_run"))
        rows = rows.join(stale, older, "left_anti")
    return rows.drop("_run")


def read_encoded(spark: SparkSession, path: str) -> DataFrame:
    """The published vectors: id, digest, embedding."""
    about = current(spark, path)[1]
    return _valid(spark, path, about, [about["id_column"], "digest", "embedding"])


def last_run(spark: SparkSession, path: str) -> dict:
    """What the last run added, changed, removed and kept."""
    run = current(spark, path)[1]["runs"][-1]
    return {name: run[name] for name in COUNTS}


def encode_changes(
    df: DataFrame,
    path: str,
    make_encoder: Callable[[], TextEncoder],
    model_name: str,
    dimension: int,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    batch_size: int = 256,
) -> DataFrame:
    """Bring the vectors at ``path`` up to date with ``df`` and return them.

    Ids must be unique and not null. A run that fails publishes nothing, so
    readers keep the last version and the next run starts from it. Another
    model, dimension or id column than that of the earlier runs is an error.
    """
    spark = df.sparkSession
    about = _published(spark, path)
    wanted = {"model": model_name, "dimension": dimension, "id_column": id_column}
    if about is not None and {k: about[k] for k in wanted} != wanted:
        raise ValueError(f"the output was encoded with other settings than {wanted}")
    now = cut_lineage(df.select(id_column, text_digest(text_column).alias("digest")))
    if not now.filter(F.col(id_column).isNull()).isEmpty():
        raise ValueError("an id is null")
    if not now.groupBy(id_column).count().filter("count > 1").isEmpty():
        raise ValueError("an id occurs more than once")
    if about is None:
        about = {**wanted, "runs": []}
    old = _valid(spark, path, about, [id_column, "digest"])
    if old is None:
        old = now.limit(0)
    both = now.join(old.withColumnRenamed("digest", "was"), id_column, "full_outer")
    state = (
        F.when(F.col("was").isNull(), "added")
        .when(F.col("digest").isNull(), "removed")
        .when(F.col("digest") != F.col("was"), "changed")
        .otherwise("kept")
    )
    states = cut_lineage(both.select(id_column, "digest", state.alias("state")))
    counts = {r["state"]: r["count"] for r in states.groupBy("state").count().collect()}
    counts = {name: counts.get(name, 0) for name in COUNTS}

    version = new_version(path)
    fresh = states.filter(F.col("state").isin("added", "changed")).select(id_column, "digest")
    if counts["added"] + counts["changed"] <= BROADCAST_IDS:
        fresh = F.broadcast(fresh)
    rows = df.select(id_column, text_column).join(fresh, id_column)
    vectors = encode_texts(rows, text_column, make_encoder, dimension, batch_size)
    vectors = vectors.select(id_column, "digest", "embedding")
    vectors.write.option("compression", "zstd").parquet(f"{version}/vectors")
    stale = states.filter(F.col("state").isin("changed", "removed")).select(id_column)
    stale.write.parquet(f"{version}/stale")
    run = {"folder": version.rsplit("/", 1)[-1], **counts}
    publish(
        spark, path, version,
        {**about, "schema": vectors.schema.jsonValue(), "runs": [*about["runs"], run]},
    )
    return read_encoded(spark, path)


def compact(spark: SparkSession, path: str) -> None:
    """Write the vectors that count into one run and publish it."""
    about = current(spark, path)[1]
    version = new_version(path)
    rows = read_encoded(spark, path)
    rows.write.option("compression", "zstd").parquet(f"{version}/vectors")
    kept = spark.read.schema(StructType.fromJson(about["schema"])).parquet(f"{version}/vectors")
    run = dict.fromkeys(COUNTS, 0) | {"folder": version.rsplit("/", 1)[-1], "kept": kept.count()}
    publish(spark, path, version, {**about, "runs": [run]})
