"""Helpers of this subpackage: stored tables, whole groups in Arrow streams, components.

Stored tables go to the shared folder named by ``spark.checkpoint.dir``. They
hold narrow columns (ids, sizes, digests), so a lost executor costs no second
pass over the texts, and a later read cannot see other rows.
"""

from __future__ import annotations

import json
import sys
import uuid
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citespark.operators.stable import shared_folder

#: A key with more rows than total / HOT_KEYS is hot, so there are at most this many.
HOT_KEYS = 65_536
#: No key below this many rows is worth special treatment.
LEAST_HOT = 1_000


def new_folder(spark: SparkSession) -> str:
    """A fresh name in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{new_folder(spark)}/{name}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A DataFrame of a few driver rows, as one literal in the plan."""
    names = [part.split()[0] for part in schema.split(",")]
    text = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    fields = ", ".join(f"{name}: {kind}" for name, kind in (p.split() for p in schema.split(",")))
    parsed = F.from_json(F.lit(text), f"array<struct<{fields}>>")
    return spark.range(1).select(F.inline(parsed))


def join_counted(
    many: DataFrame, one: DataFrame, key: str, size: str, rows: int, how: str = "left"
) -> DataFrame:
    """Join ``many`` to ``one`` (unique ``key``, ``size`` = its rows in ``many``).

    Hot keys, at most :data:`HOT_KEYS` because sizes add up to ``rows``, are
    joined by broadcast; what remains has no key above ``rows / HOT_KEYS`` rows
    (or :data:`LEAST_HOT`) and is shuffled.
    """
    limit = max(LEAST_HOT, rows // HOT_KEYS)
    hot = F.broadcast(one.filter(F.col(size) > limit))
    cold = one.filter(F.col(size) <= limit)
    return many.join(hot, key, "inner").unionByName(
        many.join(hot.select(key), key, "left_anti").join(cold, key, how)
    )


def keep_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids``, with all their columns."""
    wanted = ids.select(F.col("doc_id").alias("wanted_id")).distinct()
    return docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["wanted_id"]), "left_semi")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Re-cut a stream sorted by integer ``keys`` so that no group is split.

    Holds one batch and the group that is open at its end; callers bound the
    size of a group.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
        new = np.zeros(batch.num_rows, dtype=bool)
        for column in columns:
            new[1:] |= column[1:] != column[:-1]
        if held:
            last = held[-1]
            new[0] = any(
                last.column(last.schema.get_field_index(k))[-1].as_py() != column[0]
                for k, column in zip(keys, columns, strict=True)
            )
        starts = np.flatnonzero(new)
        if len(starts) == 0:
            held.append(batch)
            continue
        cut = int(starts[-1])
        ready = [*held, batch.slice(0, cut)] if cut else held
        if ready:
            yield pa.Table.from_batches(ready)
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def per_worker(key: tuple, make: Callable[[], object]) -> object:
    """One object per Python worker, kept for the tasks that it runs later.

    Functions travel by value, so what they hold ends with their task. A worker
    keeps its modules; the objects are put into one of them.
    """
    kept = sys.modules.setdefault("_citespark_kept", ModuleType("_citespark_kept")).__dict__
    name = repr(key)
    if name not in kept:
        kept[name] = make()
    return kept[name]


def group_bounds(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last row of each group of equal neighbours."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    if n:
        new[0] = True
    for column in columns:
        new[1:] |= column[1:] != column[:-1]
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], n)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Smallest reachable node of every node in ``edges``: columns node, component.

    Alternating large-star and small-star steps: each step points the
    neighbours of a node at the smallest one. The edges stay distributed and
    are stored after every round; only two sums reach the driver. Nodes
    without an edge to another node are not returned.
    """
    current = stored(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter("u <> v")
        .distinct(),
        "edges",
    )
    seen = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        large = stored(large.filter("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = low.select("u", F.col("m").alias("v")).unionByName(moved).distinct()
        current = stored(small, "small")
        now = current.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if seen == now:
            break
        seen = now
    pairs = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = pairs.select(F.col("component").alias("node"), "component").distinct()
    return pairs.unionByName(roots)
