"""Mixing sources to target weights by Sainte-Lague apportionment.

The words of a source, in a seeded order of its documents, are cut into blocks
of equal size. The mix is apportioned in blocks: first over the sources, then
over the shards of each source, each time to the highest quotients
``weight / (2 k + 1)``. In a shard the quota is met by whole passes over its
blocks and a seeded choice of blocks for what remains.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from citespark.llm.staging import local_rows, stored

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
BLOCK_WORDS = 32
#: Sources are named in a mixing plan, so they are few; more than this is an error.
MAX_SOURCES = 1_000_000
#: Lehmer generator modulo a prime: a seeded order that any SQL engine can state.
PRIME, FACTOR = 2_147_483_647, 48_271


def word_count(text: Column) -> Column:
    return F.coalesce(
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)
    ).cast("bigint")


def water_fill(sizes: list[int], weights: list[float], repeats: int = MAX_REPEATS) -> list[float]:
    """Targets in proportion to ``weights`` that add up to all sizes.

    A target stops at ``repeats`` times its size; the excess goes to the others
    by weight until none is above.
    """
    targets = [0.0] * len(sizes)
    rest, weight = sum(sizes), sum(weights)
    order = sorted(range(len(sizes)), key=lambda i: (repeats * sizes[i] / weights[i], i))
    for at, i in enumerate(order):
        if repeats * sizes[i] * weight > rest * weights[i]:
            for j in order[at:]:
                targets[j] = rest * weights[j] / weight
            break
        targets[i] = float(repeats * sizes[i])
        rest -= repeats * sizes[i]
        weight -= weights[i]
    return targets


def sainte_lague(weights: list[float], caps: list[int], seats: int) -> list[int]:
    """Seats by highest quotients ``weight / (2 k + 1)``, none above its cap; ties to the first."""
    seats = min(seats, sum(c for w, c in zip(weights, caps, strict=True) if w > 0))

    def at(rate: float) -> list[int]:
        return [
            min(c, math.floor(w * rate + 0.5)) if w > 0 else 0
            for w, c in zip(weights, caps, strict=True)
        ]

    low, high = 0.0, 1.0
    while sum(at(high)) < seats:
        high *= 2
    for _ in range(120):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(at(middle)) < seats else (low, middle)
    # Just below the rate that seats everyone; the last seats go one by one.
    given = [max(0, q - 1) for q in at(low)]
    quotients = [
        (-w / (2 * q + 1), i)
        for i, (w, c, q) in enumerate(zip(weights, caps, given, strict=True))
        if w > 0 and q < c
    ]
    heapq.heapify(quotients)
    for _ in range(seats - sum(given)):
        _, i = heapq.heappop(quotients)
        given[i] += 1
        if given[i] < caps[i]:
            heapq.heappush(quotients, (-weights[i] / (2 * given[i] + 1), i))
    return given


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    repeats: int = MAX_REPEATS,
    block_words: int = BLOCK_WORDS,
    seed: int = 11,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    Size is the number of words; null texts have none and give none. Sources
    in code-point order, null last as a source of its own, take ``weights`` in
    turn. ``taken`` counts the words that the mix takes from the document,
    repeats included, at most ``repeats`` times its size. The same table, seed
    and block size give the same result. Null ids are rows like others, rows
    repeated with an id share its place in the order, an empty table gives an
    empty result, other columns are ignored.

    A source is split into about as many shards as the square root of its
    documents, so that neither a shard nor the list of shards of a hot source
    is large.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
    )
    return _mixed(rows, weights, repeats, block_words, seed).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def _mixed(
    rows: DataFrame, weights: tuple[float, ...], repeats: int, block_words: int, seed: int
) -> DataFrame:
    """``rows`` (doc_id, source, size and others) with source "" and missing for null ones,
    rank, source_size, target, mix, shard and taken."""
    rows = stored(rows, "sizes")
    sources = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    found = sources.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["words"] for r in found]
    turns = [weights[i % len(weights)] for i in range(len(found))]
    targets = water_fill(sizes, turns, repeats)
    shards = [max(1, math.ceil(math.sqrt(r["n"]))) for r in found]
    blocks = [_blocks(s, block_words) for s in sizes]
    quotas = sainte_lague(
        targets, [repeats * b for b in blocks], (sum(sizes) + block_words // 2) // block_words
    )
    plan = local_rows(
        rows.sparkSession,
        [
            (r["source"], i, *more)
            for i, (r, *more) in enumerate(
                zip(found, sizes, targets, shards, quotas, strict=True)
            )
        ],
        "source string, rank int, source_size bigint, target double, shards bigint, "
        "source_quota bigint",
    )
    plan = plan.withColumn("missing", F.col("source").isNull()).withColumn(
        "source", F.coalesce("source", F.lit(""))
    )
    order = F.pmod(
        F.pmod(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)), F.lit(PRIME)) * FACTOR
        + seed,
        F.lit(PRIME),
    )
    dealt = (
        rows.withColumn("missing", F.col("source").isNull())
        .withColumn("source", F.coalesce("source", F.lit("")))
        .join(F.broadcast(plan), ["source", "missing"])
        .withColumn("mix", order)
        .withColumn("shard", F.pmod("mix", "shards"))
    )
    cells = (
        dealt.groupBy("rank", "shard")
        .agg(F.sum("size").alias("shard_words"), F.first("source_quota").alias("source_quota"))
        .groupBy("rank").applyInPandas(
            lambda group: _shard_quotas(group, repeats, block_words),
            "rank int, shard bigint, shard_words bigint, blocks bigint, quota bigint",
        )
    )
    cells = stored(cells, "quotas")
    place = Window.partitionBy("rank", "shard").orderBy("mix", "doc_id", "size")
    placed = dealt.withColumn(
        "first_word",
        F.sum("size").over(place.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"),
    ).join(cells, ["rank", "shard"], "left")
    # The prime factor deals out all blocks unless it divides their number.
    # Block j has the words floor(j * words / blocks) up to the next block's first.
    more = F.expr(
        f"""
        aggregate(
          sequence(((first_word + 1) * blocks - 1) div greatest(shard_words, 1),
                   ((first_word + greatest(size, 1)) * blocks - 1) div greatest(shard_words, 1)),
          0L,
          (sum, j) -> sum + if(
            pmod(j * ({FACTOR} + if(blocks % {FACTOR} = 0, 1, 0)) + {seed} + shard,
                 greatest(blocks, 1)) < quota % greatest(blocks, 1),
            least(first_word + size, ((j + 1) * shard_words) div greatest(blocks, 1))
              - greatest(first_word, (j * shard_words) div greatest(blocks, 1)),
            0L))
        """
    )
    taken = F.when(
        (F.col("size") > 0) & (F.col("blocks") > 0),
        F.col("size") * F.expr("quota div greatest(blocks, 1)")
        + F.when(F.expr("quota % greatest(blocks, 1)") > 0, more).otherwise(0),
    ).otherwise(0)
    return placed.withColumn("taken", taken.cast("bigint"))


def _blocks(words: int, block_words: int) -> int:
    return max(1, (words + block_words // 2) // block_words) if words else 0


def _shard_quotas(group: pd.DataFrame, repeats: int, block_words: int) -> pd.DataFrame:
    """The quota of one source over its shards."""
    group = group.sort_values("shard")
    words = [int(w) for w in group["shard_words"]]
    blocks = [_blocks(w, block_words) for w in words]
    quotas = sainte_lague(
        [float(w) for w in words], [repeats * b for b in blocks], int(group["source_quota"].iloc[0])
    )
    return pd.DataFrame(
        {
            "rank": group["rank"],
            "shard": group["shard"],
            "shard_words": words,
            "blocks": blocks,
            "quota": quotas,
        }
    )


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    repeats: int = MAX_REPEATS,
    block_words: int = BLOCK_WORDS,
    seed: int = 11,
) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them.

    A document appears ``taken / size`` times, the fraction rounded up or down:
    up when half of it is covered by the words that are taken but not given yet.
    Documents longer than the mean shard of their source, at most one for each
    shard, are rounded together, longest first. What they leave is dealt over
    the shards, which go on from it, longest first again. So the repeats of a
    source add up to its quota within about one short document a shard. Copies
    with one id in a source are rounded as one document.
    """
    digest = F.xxhash64(F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        digest.alias("digest"),
    )
    alike = (
        _mixed(rows, weights, repeats, block_words, seed)
        .filter("taken > 0")
        .groupBy(
            "rank", "shard", "shards", "source_size", "mix", "doc_id", "source", "missing", "digest"
        )
        .agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"))
        .withColumn("long", F.expr("size > source_size / shards"))
    )
    alike = stored(alike, "alike")
    long = alike.filter("long").withColumn("shard", F.lit(-1).cast("bigint"))
    long = stored(_rounded(long.withColumn("start", F.lit(0).cast("bigint"))), "long")
    left = long.groupBy("rank").agg(F.sum(F.expr("taken - times * size")).alias("left"))
    short = alike.filter("NOT long").join(left, "rank", "left").fillna(0, ["left"])
    start = "(left * (shard + 1)) div shards - (left * shard) div shards"
    short = _rounded(short.withColumn("start", F.expr(start)).drop("left"))
    names = ["doc_id", "source", "missing", "digest", "times"]
    times = short.unionByName(long).filter("times > 0")
    times = stored(times.select(*[F.col(c).alias(f"mixed_{c}") for c in names]), "times")
    repeated = docs.join(
        times,
        docs[id_col].eqNullSafe(times["mixed_doc_id"])
        & (F.coalesce(docs[source_col], F.lit("")) == times["mixed_source"])
        & (docs[source_col].isNull() == times["mixed_missing"])
        & (F.xxhash64(docs[text_col]) == times["mixed_digest"]),
    )
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), times["mixed_times"]))
    number = f"copy_{uuid.uuid4().hex}"
    return repeated.select(*[docs[c] for c in docs.columns], copies.alias(number)).drop(number)


def _rounded(alike: DataFrame) -> DataFrame:
    """``alike`` with ``times``, rounded along each (rank, shard) from ``start`` words on.

    Rows are streamed, so a shard may have any number of them.
    """
    alike = alike.repartition("rank", "shard").sortWithinPartitions(
        "rank", "shard", F.desc("size"), "mix", "doc_id", "digest"
    )
    schema = StructType([*alike.schema.fields, StructField("times", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rest = None, 0
        for batch in batches:
            times = []
            columns = (
                batch.column(batch.schema.get_field_index(c)).to_pylist()
                for c in ("rank", "shard", "start", "size", "taken")
            )
            for rank, shard, start, size, taken in zip(*columns, strict=True):
                if (rank, shard) != at:
                    at, rest = (rank, shard), start
                whole, part = divmod(taken, size)
                rest += part
                more = part > 0 and 2 * rest >= size
                rest -= size * more
                times.append(whole + more)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(times, pa.int64())], names=schema.names
            )

    return alike.mapInArrow(run, schema)


def sql(
    weights: tuple[float, ...] = WEIGHTS,
    repeats: int = MAX_REPEATS,
    block_words: int = BLOCK_WORDS,
    seed: int = 11,
) -> str:
    """The same mix in DuckDB, where every quotient is a row."""
    half = block_words // 2
    turns = " ".join(f"WHEN {i} THEN {w}::DOUBLE" for i, w in enumerate(weights))

    def blocks(words: str) -> str:
        return (
            f"CASE WHEN {words} > 0 THEN greatest(1, ({words} + {half}) // {block_words}) "
            "ELSE 0 END"
        )

    return rf"""
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), sources AS (
  SELECT source, count(*) AS n, sum(size)::BIGINT AS words,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM sized GROUP BY source
), weighted AS (
  SELECT *, CASE rank % {len(weights)} {turns} END AS weight, sum(words) OVER () AS everything
  FROM sources
), filling AS (
  SELECT *, row_number() OVER fill AS pos,
         everything - coalesce(sum({repeats} * words) OVER before, 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS rest_weight
  FROM weighted
  WINDOW fill AS (ORDER BY {repeats} * words / weight, rank),
         before AS (ORDER BY {repeats} * words / weight, rank
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT pos, rest, rest_weight FROM filling
  WHERE {repeats} * words * rest_weight > rest * weight ORDER BY pos LIMIT 1
), targets AS (
  SELECT f.source, f.rank, f.words, f.everything,
         greatest(1, ceil(sqrt(f.n)))::BIGINT AS shards,
         CASE WHEN f.pos >= l.pos THEN (l.rest * f.weight) / l.rest_weight
              ELSE {repeats} * f.words END::DOUBLE AS target
  FROM filling f LEFT JOIN level l ON true
), source_quotas AS (
  SELECT rank, count(*) AS quota FROM (
    SELECT rank, (everything + {half}) // {block_words} AS seats,
           row_number() OVER (ORDER BY target / (2 * m + 1) DESC, rank) AS place
    FROM (SELECT *, unnest(range({repeats} * ({blocks("words")}))) AS m
          FROM targets WHERE target > 0))
  WHERE place <= seats GROUP BY rank
), dealt AS (
  SELECT s.doc_id, s.size, t.rank, t.words AS source_size, t.target, t.shards,
         ((coalesce(s.doc_id, -1) % {PRIME} + {PRIME}) % {PRIME} * {FACTOR} + {seed}) % {PRIME}
           AS mix
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), sharded AS (
  SELECT *, mix % shards AS shard,
         (sum(size) OVER (PARTITION BY rank, mix % shards ORDER BY mix, doc_id, size
                          ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS first_word
  FROM dealt
), cells AS (
  SELECT rank, shard, sum(size)::BIGINT AS words,
         {blocks("sum(size)::BIGINT")} AS blocks
  FROM sharded GROUP BY rank, shard
), shard_quotas AS (
  SELECT rank, shard, count(*) AS quota FROM (
    SELECT c.rank, c.shard, q.quota AS seats,
           row_number() OVER (PARTITION BY c.rank
                              ORDER BY c.words::DOUBLE / (2 * m + 1) DESC, c.shard) AS place
    FROM (SELECT *, unnest(range({repeats} * blocks)) AS m FROM cells WHERE words > 0) c
    JOIN source_quotas q ON c.rank = q.rank)
  WHERE place <= seats GROUP BY rank, shard
)
SELECT s.doc_id, s.size, s.source_size, s.target,
       CASE WHEN s.size > 0 THEN
         s.size * (coalesce(q.quota, 0) // c.blocks)
         + list_sum(list_transform(
             range(((s.first_word + 1) * c.blocks - 1) // c.words,
                   ((s.first_word + s.size) * c.blocks - 1) // c.words + 1),
             lambda j: CASE
               WHEN (j * {FACTOR} + {seed} + s.shard) % c.blocks < coalesce(q.quota, 0) % c.blocks
               THEN least(s.first_word + s.size, ((j + 1) * c.words) // c.blocks)
                    - greatest(s.first_word, (j * c.words) // c.blocks)
               ELSE 0 END))
       ELSE 0 END::BIGINT AS taken
FROM sharded s JOIN cells c ON s.rank = c.rank AND s.shard = c.shard
LEFT JOIN shard_quotas q ON s.rank = q.rank AND s.shard = q.shard
"""
