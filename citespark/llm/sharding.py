"""Sharding by sampled splitters, in DataFrame operations only.

Keys are hashes of the text, so equal texts are neighbours. A size-weighted
sample of keys gives quantile boundaries for many small ranges; a range that
turns out overfull is subdivided, a text with many copies gets ranges of its
own. Ranges are then dealt to shards by their exact bytes, largest first.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citespark.llm.staging import local_rows, stored

ROW_BYTES = 16
SAMPLE = 16_384
#: Key bits that find the few ranges a key can be in.
CELL_BITS = 12


def shard_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 40,
    ranges_per_shard: int = 64,
    seed: int = 7,
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: sizes (UTF-8 bytes plus 16) of the shards are near
    equal. Equal texts share a shard, unless their group alone exceeds a
    shard's share; then it is subdivided by id. Slots count from 0 in each
    shard, in the order of its ranges. A null text counts as an empty one. Null
    ids are rows like others, repeated rows get slots of their own, an empty
    table gives an empty result, other columns are ignored.

    Driver and broadcasts hold one row per range, a number set by ``shards``
    and ``ranges_per_shard`` and not by the table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
        ),
        "keys",
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    share = max(1, -(-total // shards))
    piece_bytes = max(1, -(-total // (shards * ranges_per_shard)))

    # Texts whose copies exceed a range: at most shards * ranges_per_shard of them.
    heavy = (
        rows.groupBy("key").agg(F.sum("size").alias("key_bytes"))
        .filter(F.col("key_bytes") > piece_bytes)
    )
    heavy = stored(heavy, "heavy")
    ranges = stored(_ranges(rows, heavy, total, shards * ranges_per_shard, seed), "ranges")
    cells = ranges.select(
        "range_id",
        "lo",
        "hi",
        F.explode(
            F.sequence(F.shiftright("lo", 64 - CELL_BITS), F.shiftright("hi", 64 - CELL_BITS))
        ).alias("cell"),
    )
    keyed = rows.join(F.broadcast(heavy), "key", "left").withColumn(
        "cell", F.shiftright("key", 64 - CELL_BITS)
    )
    found = keyed.alias("r").join(
        F.broadcast(cells).alias("c"),
        (F.col("r.cell") == F.col("c.cell"))
        & F.col("r.key").between(F.col("c.lo"), F.col("c.hi")),
        "left",
    ).select("doc_id", "size", "text_crc32", "key", "key_bytes", "range_id", "lo", "hi")
    light = F.col("key_bytes").isNull()
    filled = stored(
        found.filter(light).groupBy("range_id").agg(F.sum("size").alias("range_bytes")), "filled"
    )
    # An overfull range is cut at even key distances; keys are hashes, so these are quantiles.
    width = F.greatest(F.lit(1.0), F.col("hi").cast("double") - F.col("lo").cast("double"))
    at = (F.col("key").cast("double") - F.col("lo").cast("double")) / width
    parts = F.ceil(F.col("range_bytes") / piece_bytes)
    sub = F.least(F.floor(at * parts), parts - 1)
    copies = F.pmod(
        F.xxhash64("doc_id", F.lit(seed)), F.ceil(F.col("key_bytes") / piece_bytes)
    )
    placed = found.join(F.broadcast(filled), "range_id", "left").select(
        "doc_id",
        "size",
        "text_crc32",
        "key",
        F.when(light, F.col("range_id")).otherwise(F.col("key")).alias("home"),
        F.when(light, sub).otherwise(copies).alias("sub"),
        # A group of copies that fits a shard moves as one, a larger one by its parts.
        (~light & (F.col("key_bytes") <= share)).alias("together"),
        light.alias("light"),
    )
    placed = placed.withColumn("piece", F.xxhash64("light", "home", "sub"))
    pieces = (
        placed.groupBy("piece", "home", "together", "light", "sub")
        .agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
        .orderBy("light", "home", "sub")
        .collect()
    )
    table = F.broadcast(
        local_rows(
            docs.sparkSession,
            _deal(pieces, shards),
            "piece bigint, shard int, first_slot bigint",
        )
    )
    order = Window.partitionBy("piece").orderBy("key", "doc_id", "size", "text_crc32")
    return placed.withColumn("nth", F.row_number().over(order)).join(table, "piece").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first_slot") + F.col("nth") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _ranges(rows: DataFrame, heavy: DataFrame, total: int, count: int, seed: int) -> DataFrame:
    """Key ranges between weighted quantiles of the sample: range_id, lo, hi (both inclusive)."""
    chance = F.col("size") * (SAMPLE / max(total, 1))
    uniform = F.pmod(F.xxhash64("doc_id", "key", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    sample = (
        rows.join(F.broadcast(heavy), "key", "left_anti")
        .filter(uniform < chance)
        .groupBy("key")
        # A row drawn for certain stands for its size, any other for one draw.
        .agg(F.sum(F.greatest(chance, F.lit(1.0))).alias("weight"))
    )
    by_key = Window.orderBy("key")
    everything = Window.partitionBy()
    below = F.sum("weight").over(by_key) - F.col("weight")
    bounds = (
        sample.select("key", below.alias("below"), F.sum("weight").over(everything).alias("all"))
        .groupBy(F.floor(F.col("below") / F.col("all") * count).alias("quantile"))
        .agg(F.min("key").alias("lo"))
    )
    lowest = -(1 << 63)
    start = local_rows(rows.sparkSession, [(lowest,)], "lo bigint")
    bounds = bounds.select("lo").unionByName(start).distinct()
    return bounds.select(
        F.row_number().over(Window.orderBy("lo")).cast("bigint").alias("range_id"),
        "lo",
        F.coalesce(
            F.lead("lo").over(Window.orderBy("lo")) - 1, F.lit((1 << 63) - 1)
        ).alias("hi"),
    )


def _deal(pieces, shards: int) -> list[tuple]:
    """(piece, shard, first slot): the largest item goes to the emptiest shard."""
    items: dict[tuple, list] = {}
    for row in pieces:
        name = (row["light"], row["home"], -1 if row["together"] else row["sub"])
        items.setdefault(name, []).append(row)
    sizes = {name: sum(r["bytes"] for r in found) for name, found in items.items()}
    filling = [(0, shard) for shard in range(shards)]
    slots = [0] * shards
    home: dict[tuple, int] = {}
    for name in sorted(items, key=lambda name: (-sizes[name], name)):
        full, shard = heapq.heappop(filling)
        home[name] = shard
        heapq.heappush(filling, (full + sizes[name], shard))
    dealt = []
    for name in sorted(items):
        shard = home[name]
        for row in items[name]:
            dealt.append((row["piece"], shard, slots[shard]))
            slots[shard] += row["n"]
    return dealt
