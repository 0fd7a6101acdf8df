"""Approximate search by sign codes in several tables, probed in the order of their margins.

Each table has its own hyperplanes; a vector's code is the side it lies on of
each. A query's neighbour differs from it in bits whose hyperplanes pass close
to the query, so buckets are probed by the sum of the squared distances to the
hyperplanes of the flipped bits, over all tables together. How many tables and
buckets a search needs is measured against exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.functions.vectors import as_matrix
from citespark.operators.sampling import DEFAULT_SEED, sample_by_key
from citespark.operators.search import (
    BROADCAST_BYTES,
    KEPT_BYTES,
    MARGIN,
    PARTIAL_SCHEMA,
    SCORE_DECIMALS,
    WHOLE_PART_ROWS,
    _batch,
    _BestK,
    best_per_query,
    check_unit_vectors,
    exact_topk,
    over_query_parts,
    whole_parts,
)
from citespark.operators.stable import cut_lineage, run_once

MOST_BITS = 12
MOST_TABLES = 16
#: Documents that a bucket should hold.
BUCKET_ROWS = 64
TUNING_QUERIES = 256
#: Share of the documents in a query's probed buckets, counted once per table, from which all are
#: scored. Scoring a pair takes about a sixteenth of offering it once per bucket.
DENSE_SHARE = 1 / 16
#: Values of the score matrix of all buckets that are sorted at once.
SORTED_VALUES = 1 << 22
#: Values that one edge is looked for among at once: they stay in the cache of a core.
EDGE_VALUES = 1 << 16


@dataclass(frozen=True)
class SignTables:
    """``planes`` (tables × bits × dimension), and how many buckets a query probes."""

    planes: np.ndarray
    probes: int

    @property
    def buckets(self) -> int:
        return self.planes.shape[0] << self.planes.shape[1]

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """Bucket of each vector in each table; tables number their buckets one after the other."""
        tables, bits, dimension = self.planes.shape
        sides = vectors.astype(np.float64) @ self.planes.reshape(-1, dimension).T >= 0
        own = sides.reshape(len(vectors), tables, bits) @ (1 << np.arange(bits))
        return own + (np.arange(tables) << bits)

    def order(self, vectors: np.ndarray, count: int) -> np.ndarray:
        """The first ``count`` buckets of each vector by summed squared margins."""
        tables, bits, dimension = self.planes.shape
        flips = np.arange(1 << bits)
        flipped = (flips[:, None] >> np.arange(bits) & 1).astype(np.float64)
        found = [np.empty((0, count), dtype=np.int64)]
        height = max(1, SORTED_VALUES // self.buckets)
        for at in range(0, len(vectors), height):
            part = vectors[at : at + height].astype(np.float64)
            margins = (part @ self.planes.reshape(-1, dimension).T) ** 2
            costs = margins.reshape(-1, tables, bits) @ flipped.T
            best = np.argsort(costs.reshape(len(part), -1), axis=1, kind="stable")[:, :count]
            own = np.take_along_axis(self.codes(part), best >> bits, axis=1)
            # A table's number is above its bits, so the flip changes the code alone.
            found.append(own ^ (best & ((1 << bits) - 1)))
        return np.concatenate(found)

    def margins(self, vectors: np.ndarray) -> np.ndarray:
        """Squared distances of each vector to the hyperplanes, by table and bit."""
        tables, bits, dimension = self.planes.shape
        far = vectors.astype(np.float64) @ self.planes.reshape(-1, dimension).T
        return (far * far).reshape(-1, tables, bits)

    def edges(self, margins: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """The sum of margins of each vector's ``count``-th bucket, and its place among all flips."""
        tables, bits, _ = self.planes.shape
        cuts, lasts = np.empty(len(margins)), np.empty(len(margins), dtype=np.int64)
        height = max(1, EDGE_VALUES // self.buckets)
        for at in range(0, len(margins), height):
            part = margins[at : at + height]
            costs = np.zeros((len(part), tables, 1))
            for bit in range(bits):
                costs = np.concatenate([costs, costs + part[:, :, bit, None]], axis=2)
            costs = costs.reshape(len(part), -1)
            cut = np.partition(costs, count - 1, axis=1)[:, count - 1 : count]
            ties = costs == cut
            last = np.argmax(ties, axis=1)
            for row in np.flatnonzero(ties.sum(axis=1) > 1):
                # Ties at the edge go to the lower number, as in a stable sort.
                left = count - np.count_nonzero(costs[row] < cut[row])
                last[row] = np.flatnonzero(ties[row])[left - 1]
            cuts[at : at + height], lasts[at : at + height] = cut[:, 0], last
        return cuts, lasts

    def probed_bits(self, vectors: np.ndarray, count: int) -> np.ndarray:
        """The buckets of :meth:`order` as bits of each vector, the lowest first."""
        tables, bits, dimension = self.planes.shape
        flips = np.arange(1 << bits)
        flipped = (flips[:, None] >> np.arange(bits) & 1).astype(np.float64)
        found = [np.empty((0, -(-self.buckets // 8)), dtype=np.uint8)]
        height = max(1, SORTED_VALUES // self.buckets)
        for at in range(0, len(vectors), height):
            part = vectors[at : at + height].astype(np.float64)
            margins = (part @ self.planes.reshape(-1, dimension).T) ** 2
            costs = (margins.reshape(-1, tables, bits) @ flipped.T).reshape(len(part), -1)
            last = np.partition(costs, count - 1, axis=1)[:, count - 1 : count]
            first, ties = costs < last, costs == last
            # Ties at the edge go to the lower number, as in a stable sort.
            left = count - first.sum(axis=1, keepdims=True)
            first |= ties & (np.cumsum(ties, axis=1) <= left)
            own = self.codes(part) & ((1 << bits) - 1)
            by_flip = first.reshape(len(part), tables, -1)
            mask = np.take_along_axis(by_flip, own[:, :, None] ^ flips, axis=2)
            found.append(np.packbits(mask.reshape(len(part), -1), axis=1, bitorder="little"))
        return np.concatenate(found)


def sign_tables(
    tables: int, bits: int, dimension: int, probes: int, seed: int = DEFAULT_SEED
) -> SignTables:
    """Random hyperplanes from a seed."""
    if not 0 < bits <= MOST_BITS or not 0 < tables <= MOST_TABLES:
        raise ValueError(f"bits must be at most {MOST_BITS}, tables at most {MOST_TABLES}")
    if probes <= 0:
        raise ValueError("probes must be positive")
    planes = np.random.default_rng(seed).standard_normal((tables, bits, dimension))
    planes /= np.linalg.norm(planes, axis=2, keepdims=True)
    return SignTables(planes, min(probes, tables << bits))


def fit_tables(
    documents: DataFrame,
    dimension: int,
    recall: float = 0.95,
    k: int = 10,
    bits: int | None = None,
    seed: int = DEFAULT_SEED,
) -> tuple[SignTables, list[tuple[int, int, float]]]:
    """Tables and probes that reach ``recall`` at the least work, and what others would take.

    At most TUNING_QUERIES sampled documents are searched exactly. For 1, 2, 4,
    ... tables, the place of each neighbour's best bucket in its query's order
    tells how many probes find it. Work is the share of rows that the probed
    buckets hold; the list has (tables, probes, work) of every choice.
    """
    total = documents.count()
    if not total:
        raise ValueError("there are no documents")
    bits = bits or int(np.clip(round(np.log2(max(2, total / BUCKET_ROWS))), 2, MOST_BITS))
    rows = sample_by_key(documents, "doc_id", min(total, TUNING_QUERIES), seed)
    asked = cut_lineage(rows.select(F.col("doc_id").alias("query_id"), "embedding"))
    true = exact_topk(asked, documents, k + 1, dimension).filter("doc_id <> query_id")
    pairs = true.join(documents.select("doc_id", "embedding"), "doc_id").toArrow()
    held = asked.orderBy("query_id").toArrow()
    queries = as_matrix(held.column("embedding"), dimension)
    owner = np.searchsorted(held.column("query_id").to_numpy(), pairs.column("query_id").to_numpy())
    neighbours = as_matrix(pairs.column("embedding"), dimension)
    if not len(owner):
        return sign_tables(1, bits, dimension, 1 << bits, seed), []
    choices = []
    for tables in (1 << i for i in range(MOST_TABLES.bit_length())):
        plan = sign_tables(tables, bits, dimension, tables << bits, seed)
        order = plan.order(queries, plan.buckets)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(plan.buckets)[None, :], axis=1)
        first = place[owner[:, None], plan.codes(neighbours)].min(axis=1)
        probes = int(np.quantile(first, (1 + recall) / 2, method="higher")) + 1
        choices.append((tables, probes, probes / (1 << bits)))
    tables, probes, _ = min(choices, key=lambda c: (c[2], c[0]))
    return sign_tables(tables, bits, dimension, probes, seed), choices


class _DistinctBestK(_BestK):
    """Best k of documents that may be offered once per table."""

    def _merge(self) -> None:
        parts = zip(*[self.held, *self.waiting])
        rows, docs, scores = (np.concatenate(part) for part in parts)
        order = np.lexsort((docs, -scores, rows))
        rows, docs, scores = rows[order], docs[order], scores[order]
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[1:] != rows[:-1]) | (docs[1:] != docs[:-1])
        self.held, self.waiting = (rows[new], docs[new], scores[new]), []
        super()._merge()


class _ProbedBestK(_DistinctBestK):
    """Best k of the documents that share a probed bucket with their query.

    All pairs are scored; whether a bucket is shared is asked only of those that
    would be among the best. A shared bucket is a flip of the query's code whose
    margins, added from the lowest bit on, do not pass the edge of the probes.
    """

    def __init__(self, names: np.ndarray, matrix: np.ndarray, k: int, plan: SignTables) -> None:
        super().__init__(names, matrix, k)
        self.plan = plan
        self.margins = plan.margins(matrix)
        self.cut, self.last = plan.edges(self.margins, plan.probes)
        self.own = plan.codes(matrix)
        self.theirs = self.own[:0]

    def add(self, doc_ids: np.ndarray, documents: np.ndarray, rows: np.ndarray) -> None:
        for at in range(0, len(doc_ids), 4096):
            part = documents[at : at + 4096]
            self.theirs = self.plan.codes(part)
            super().add(doc_ids[at : at + 4096], part, rows)

    def _shared(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether queries numbered ``rows`` probe a bucket of the documents ``at`` of the tile."""
        tables, bits, _ = self.plan.planes.shape
        shared = np.empty(len(rows), dtype=bool)
        for low in range(0, len(rows), 8192):
            mine, there = rows[low : low + 8192], at[low : low + 8192]
            # Numbers of a table differ in their bits alone.
            flips = self.own[mine] ^ self.theirs[there]
            margins, cost = self.margins[mine], np.zeros(flips.shape)
            for bit in range(bits):
                cost += margins[:, :, bit] * (flips >> bit & 1)
            place, cut = flips + (np.arange(tables) << bits), self.cut[mine, None]
            reached = (cost < cut) | ((cost == cut) & (place <= self.last[mine, None]))
            shared[low : low + 8192] = reached.any(axis=1)
        return shared

    def _candidates(
        self, rows: np.ndarray, doc_ids: np.ndarray, documents: np.ndarray, error: float
    ):
        scores = self.queries[rows] @ documents.T
        floor, width = self.floor[rows], len(doc_ids)
        unset = np.flatnonzero(np.isneginf(floor))
        # The first floor is that of the k-th of the likeliest documents that share a bucket.
        first = min(width, 4 * self.k + 24)
        if len(unset) and first >= self.k:
            at = np.argpartition(scores[unset], width - first, axis=1)[:, width - first :]
            mine = np.repeat(rows[unset], first)
            shared = self._shared(mine, at.ravel()).reshape(at.shape)
            best = np.where(shared, np.take_along_axis(scores[unset], at, axis=1), -np.inf)
            kth = np.partition(best, first - self.k, axis=1)[:, first - self.k].astype(np.float64)
            floor[unset] = np.round(kth - error, SCORE_DECIMALS) - MARGIN
            self.floor[rows] = floor
        likely = np.flatnonzero(scores >= (floor - error).astype(np.float32)[:, None])
        at_row, at_doc = np.divmod(likely, width)
        kept = self._shared(rows[at_row], at_doc)
        at_row, at_doc = at_row[kept], at_doc[kept]
        return self._rated(rows[at_row], doc_ids[at_doc], documents, at_doc)


def _bucket_column(plan: SignTables, dimension: int, count: int | None):
    """Arrow UDF: a vector's own buckets, or the first ``count`` that a query probes."""

    @F.arrow_udf("array<int>")
    def buckets(vectors: pa.Array) -> pa.Array:
        matrix = as_matrix(vectors, dimension)
        found = plan.codes(matrix) if count is None else plan.order(matrix, count)
        offsets = np.arange(len(matrix) + 1, dtype=np.int32) * found.shape[1]
        return pa.ListArray.from_arrays(
            pa.array(offsets), pa.array(found.ravel().astype(np.int32))
        )

    return run_once(buckets)


def _bits_column(plan: SignTables, dimension: int):
    """Arrow UDF: the buckets that a query probes, as bits."""

    @F.arrow_udf("binary")
    def probed(vectors: pa.Array) -> pa.Array:
        found = plan.probed_bits(as_matrix(vectors, dimension), plan.probes)
        return pa.array([b.tobytes() for b in found], pa.binary())

    return run_once(probed)


def lsh_tables_topk(
    queries: DataFrame,
    documents: DataFrame,
    plan: SignTables,
    k: int,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Best k documents per query among those in one of its probed buckets.

    Documents are laid out by bucket, once per table, and stream past the
    broadcast queries; a document that shares several buckets with a query counts
    once. Queries are counted; with the bits of their buckets and the best that a
    task keeps at most ``broadcast_bytes`` are in use at once, more are searched
    in parts. If the probed buckets hold DENSE_SHARE of the documents or more, all
    tables counted, parts meet each document once, in a task of their own, and the
    buckets of a pair are compared when its score is among the best. All buckets
    give the exact result. Document ids must be unique.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    dimension = plan.planes.shape[2]
    asked = check_unit_vectors(queries.select("query_id", "embedding"), dimension)
    size = dimension * 4 + -(-plan.buckets // 8) + k * KEPT_BYTES
    n_queries = queries.count()
    parts = max(1, -(-n_queries * size // broadcast_bytes))
    if parts > 1 and plan.probes >= DENSE_SHARE * (1 << plan.planes.shape[1]):
        return best_per_query(_in_parts(asked, n_queries, documents, plan, k), k)
    asked = asked.withColumn("_probed", _bits_column(plan, dimension)("embedding"))
    placed = _by_bucket(documents, plan)
    if parts > 1:
        placed = cut_lineage(placed)
    found = None
    for part in range(parts):
        mine = asked
        if parts > 1:
            mine = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        exact = best_per_query(_streamed(mine.toArrow(), placed, plan, k), k)
        found = exact if found is None else found.unionByName(exact)
    return found


def _in_parts(
    asked: DataFrame, n_queries: int, documents: DataFrame, plan: SignTables, k: int
) -> DataFrame:
    """Best k of each query, a part of the queries against all documents in a task."""
    dimension = plan.planes.shape[2]

    def score(batches: Iterator[tuple[int, pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
        # Queries come first. Copies: a batch is not kept.
        asked, best = [], None
        for side, batch in batches:
            ids = batch.column("_id").to_numpy(zero_copy_only=False)
            vectors = as_matrix(batch.column("embedding"), dimension, unit=side == 1)
            if side == 0:
                asked.append((ids.copy(), vectors.copy()))
            elif asked:
                if best is None:
                    best = _ProbedBestK(*(np.concatenate(x) for x in zip(*asked)), k, plan)
                best.add(ids, vectors, np.arange(len(best.query_ids)))
        if best:
            yield _batch(*best.result())

    spark = documents.sparkSession
    parts = whole_parts(spark, n_queries, documents.count(), WHOLE_PART_ROWS)
    return over_query_parts(
        asked.select(F.col("query_id").cast("bigint").alias("_id"), "embedding"),
        [documents.select(F.col("doc_id").cast("bigint").alias("_id"), "embedding")],
        parts,
        score,
        PARTIAL_SCHEMA,
    )


def _by_bucket(documents: DataFrame, plan: SignTables) -> DataFrame:
    """(_bucket, doc_id, embedding), a row per table, a bucket's rows together.

    Ranges of (bucket, document) split a bucket that holds a large share of all rows.
    """
    own = _bucket_column(plan, plan.planes.shape[2], None)("embedding")
    rows = documents.select(F.col("doc_id").cast("bigint"), "embedding")
    return (
        rows.select(F.explode(own).alias("_bucket"), "doc_id", "embedding")
        .repartitionByRange("_bucket", "doc_id")
        .sortWithinPartitions("_bucket")
    )


def _streamed(held: pa.Table, placed: DataFrame, plan: SignTables, k: int) -> DataFrame:
    dimension = plan.planes.shape[2]
    bits = np.frombuffer(b"".join(held.column("_probed").to_pylist()), dtype=np.uint8)
    shared = placed.sparkSession.sparkContext.broadcast(
        (
            held.column("query_id").to_numpy(),
            as_matrix(held.column("embedding"), dimension),
            bits.reshape(held.num_rows, -(-plan.buckets // 8)),
        )
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix, probed = shared.value
        best = _DistinctBestK(np.arange(len(names)), matrix, k)
        for batch in batches:
            docs = batch.column(1).to_numpy()
            vectors = as_matrix(batch.column(2), dimension, unit=True)
            own = batch.column(0).to_numpy()
            by_bucket = np.argsort(own, kind="stable")
            found, starts = np.unique(own[by_bucket], return_index=True)
            for bucket, here in zip(found.tolist(), np.split(by_bucket, starts[1:])):
                rows = np.flatnonzero(probed[:, bucket >> 3] >> (bucket & 7) & 1)
                if len(rows):
                    best.add(docs[here], vectors[here], rows)
        rows, docs, scores = best.result()
        yield _batch(names[rows], docs, scores).append_column("_row", pa.array(rows, pa.int64()))

    wanted = placed.select("_bucket", "doc_id", "embedding")
    partial = wanted.mapInArrow(score, f"{PARTIAL_SCHEMA}, _row bigint")
    if len(plan.planes) > 1:
        # The buckets of a document lie in different tasks.
        partial = partial.dropDuplicates(["_row", "doc_id"])
    return partial.drop("_row")


def rows_read(queries: DataFrame, documents: DataFrame, plan: SignTables) -> DataFrame:
    """Rows that the probed buckets of each query hold: query_id, buckets, rows_read.

    A document counts once per table that brings it up.
    """
    dimension = plan.planes.shape[2]
    own = _bucket_column(plan, dimension, None)("embedding")
    sizes = (
        documents.select(F.explode(own).alias("bucket")).groupBy("bucket")
        .agg(F.count("*").alias("n"))
    )
    probed = queries.select(
        "query_id",
        F.explode(_bucket_column(plan, dimension, plan.probes)("embedding")).alias("bucket"),
    )
    # One row per bucket: at most MOST_TABLES << MOST_BITS.
    return (
        probed.join(F.broadcast(sizes), "bucket", "left").groupBy("query_id")
        .agg(F.count("*").alias("buckets"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_read"))
    )
