"""Exact deduplication by skew-safe combining.

Copies are combined three times: inside each task (the map side of the first
aggregation), then per digest and salt, then over the salts. Every grouping
has the whole normalised text among its keys, so a digest alone never decides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citespark.llm.staging import join_counted, stored

#: Digests that may be broadcast as 8-byte keys; beyond it all texts are combined.
BROADCAST_KEYS = 1 << 20


def normalised(text: Column) -> Column:
    """Null as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 16,
    digest: Callable[[Column], Column] = sha256,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the row with the smallest id stays. A null text
    equals an empty one. Null ids lose to others; a group of null ids only has
    a null ``keep_id``. Of rows repeated with the same id one is kept. Other
    columns are ignored, an empty table gives an empty result.

    Texts whose digest is unique cannot have a copy and are not shuffled, as
    long as the repeated digests fit a counted broadcast; a table with more of
    them shuffles all texts and gives the same rows. Texts that share a digest
    without being equal form groups of their own.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm")
    )
    ids = stored(
        rows.select(
            "doc_id",
            digest(F.col("norm")).alias("digest"),
            sha256(F.col("norm")).alias("sha"),
            F.monotonically_increasing_id().alias("row_id"),
        ),
        "digests",
    )
    total = ids.count()
    repeated = stored(
        ids.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1")
        .select(F.xxhash64("digest").alias("key")).distinct(),
        "repeated",
    )
    keyed = rows.withColumn("digest", digest(F.col("norm")))
    if repeated.count() <= broadcast_keys:
        keyed = keyed.join(
            F.broadcast(repeated), F.xxhash64("digest") == F.col("key"), "left_semi"
        )
    classes = stored(_combine(keyed, salts).select("digest", "keep_id", "group_size"), "classes")

    clashing = stored(
        classes.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"),
        "clashing",
    )
    found = ids
    apart = None
    if not clashing.isEmpty():
        # Several texts under one digest: told apart by the text itself.
        clash = keyed.join(clashing, "digest", "left_semi")
        apart = (
            clash.join(_combine(clash, salts), ["digest", "norm"])
            .select("doc_id", "keep_id", "group_size", sha256(F.col("norm")).alias("sha"))
            .withColumn("row_id", F.monotonically_increasing_id())
        )
        found = ids.join(clashing, "digest", "left_anti")
        classes = classes.join(clashing, "digest", "left_anti")
    joined = join_counted(found, classes, "digest", "group_size", total).select(
        "doc_id",
        # Without a class the digest is unique: the row is its own group.
        F.when(F.col("group_size").isNull(), F.col("doc_id"))
        .otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        "sha",
        "row_id",
    )
    if apart is not None:
        joined = stored(joined.unionByName(apart), "joined")
    winner = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    again = stored(
        joined.filter(winner).groupBy("doc_id", "sha")
        .agg(F.count("*").alias("n"), F.min("row_id").alias("first"))
        .filter("n > 1"),
        "again",
    )
    first = F.lit(True)
    if not again.isEmpty():
        again = again.select(
            F.struct("doc_id", "sha").alias("same"), "n", F.col("first").alias("first_row")
        )
        joined = join_counted(
            joined.withColumn("same", F.struct("doc_id", "sha")), again, "same", "n", total
        )
        first = F.col("first_row").isNull() | (F.col("first_row") == F.col("row_id"))
    return joined.select(
        "doc_id",
        "keep_id",
        "group_size",
        (winner & first).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names."""
    tag = uuid.uuid4().hex
    mark, stays, many = f"own_{tag}", f"stays_{tag}", f"repeated_{tag}"
    found = exact_dedup(docs, id_col, text_col).filter("kept")
    found = found.select(F.struct("doc_id", "text_sha256").alias(stays))
    own = F.struct(
        F.col(id_col).alias("doc_id"),
        F.lower(F.hex(sha256(normalised(F.col(text_col))))).alias("text_sha256"),
    )
    kept = docs.withColumn(mark, own).join(
        found, F.col(mark).eqNullSafe(F.col(stays)), "left_semi"
    )
    repeated = stored(
        docs.groupBy(F.col(id_col).alias(many)).agg(F.count("*").alias("n"))
        .filter("n > 1").select(many),
        "repeated-ids",
    )
    if repeated.isEmpty():
        return kept.drop(mark)
    # Rows that repeat an id with one text are one document: any of them stands for all.
    again = F.col(id_col).eqNullSafe(F.col(many))
    single = kept.join(repeated, again, "left_anti")
    several = kept.join(repeated, again, "left_semi").dropDuplicates([mark])
    return single.unionByName(several).drop(mark)


def _combine(keyed: DataFrame, salts: int) -> DataFrame:
    """Groups of equal texts: digest, norm, keep_id, group_size."""
    salted = (
        keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        .groupBy("digest", "salt", "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    )
    return salted.groupBy("digest", "norm").agg(
        F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )


SQL = r"""
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM (SELECT doc_id,
             regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm
      FROM documents)
"""
