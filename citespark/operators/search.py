"""Top-k vector search as partitioned matrix products.

Every search compares queries and documents that share a *cell*. Exact search
puts everything into one cell; approximate search uses many. Inside a cell the
score matrix is computed in tiles by numpy, and only the best k documents per
query leave a task, never the pairs themselves.

Two ways to bring the sides together:

* a small query set, its size checked by counting, is broadcast and the
  document table is streamed through the tasks without a shuffle;
* otherwise each cell becomes a grid of equal parts. Queries are copied to the
  document parts and documents to the query parts, so one cell that holds a
  third of all rows is spread over as many tasks as its size asks for. Each pair
  of parts is a task of its own, which holds the queries and reads the documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citespark.functions.vectors import as_matrix, is_finite, is_unit
from citespark.operators.stable import require_columns

BROADCAST_BYTES = 64 * 1024 * 1024
QUERY_PART_ROWS = 8_192
DOCUMENT_PART_ROWS = 65_536
# Parts of a cell and side while they stay below the rows below; larger cells have larger parts.
MOST_PARTS = 16
LARGEST_QUERY_PART = 32_768
LARGEST_DOCUMENT_PART = 131_072
# Pairs worth a task; grids with fewer per pair of parts have several of them in a task.
TASK_PAIRS = 1 << 26
TILE_VALUES = 1 << 22
# Pairs whose exact scores are taken at once: their rows stay in the cache of a core.
RATED_PAIRS = 512
# Of a probed cell: its number in the query's list, and the query in the cell's list.
CELL_BYTES = 12
# Query, document and score of one of the best that a task keeps.
KEPT_BYTES = 24
FLOOR_BYTES = 8
# Queries of a part that meets all documents in one task.
WHOLE_PART_ROWS = 16_384

# Scores are compared at nine decimals: finer than the float32 vectors carry,
# and coarse enough that summation order never decides a rank.
SCORE_DECIMALS = 9
MARGIN = 2e-9

PARTIAL_SCHEMA = "query_id bigint, doc_id bigint, score double"


def check_unit_vectors(df: DataFrame, dimension: int, column: str = "embedding") -> DataFrame:
    """Pass rows through, failing the job on a wrong dimension, gap or length."""
    vector = F.col(column)
    fine = F.coalesce(
        (F.size(vector) == dimension) & is_finite(vector) & is_unit(vector), F.lit(False)
    )
    message = F.lit(f"{column} must hold {dimension} finite numbers of unit length")
    return df.withColumn(column, F.when(fine, vector).otherwise(F.raise_error(message)))


def first_k(rows: np.ndarray, docs: np.ndarray, scores: np.ndarray, k: int):
    """Sort by (row, score descending, document) and keep k per row, with ranks."""
    order = np.lexsort((docs, -scores, rows))
    rows, docs, scores = rows[order], docs[order], scores[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    best = rank < k
    return rows[best], docs[best], scores[best], rank[best]


class _BestK:
    """The best k documents of each query seen so far by one task.

    Tiles are scored in float32. What may reach a query's best k, given the
    largest rounding error possible, is scored again in float64 and compared.
    """

    def __init__(
        self,
        query_ids: np.ndarray,
        queries: np.ndarray,
        k: int,
        known: np.ndarray | None = None,
    ) -> None:
        self.query_ids, self.queries, self.k = query_ids, queries, k
        n, dimension = queries.shape
        length = np.linalg.norm(queries, axis=1).max() if n else 0.0
        self.error = 1.01 * (dimension + 2) * 2.0**-24 * length
        # Score and document of the k-th best; what does not beat them is dropped.
        self.floor = np.full(n, -np.inf) if known is None else known - MARGIN
        self.last_doc = np.full(n, np.iinfo(np.int64).max)
        self.held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        self.waiting: list[tuple] = []
        self.n_waiting = 0

    def add(self, doc_ids: np.ndarray, documents: np.ndarray, rows: np.ndarray) -> None:
        """Offer documents to the queries numbered ``rows``."""
        width = max(1, min(len(doc_ids), 4096))
        # Scores of a few MiB, so that a tile is filled and searched in the cache.
        height = max(1, TILE_VALUES // 4 // width)
        for d in range(0, len(doc_ids), width):
            names, part = doc_ids[d : d + width], documents[d : d + width]
            error = self.error * np.linalg.norm(part, axis=1).max() + MARGIN
            for q in range(0, len(rows), height):
                self._keep(self._candidates(rows[q : q + height], names, part, error))

    def _candidates(
        self, rows: np.ndarray, doc_ids: np.ndarray, documents: np.ndarray, error: float
    ):
        scores = self.queries[rows] @ documents.T
        floor = self.floor[rows]
        unset = np.flatnonzero(np.isneginf(floor))
        if len(unset) and len(doc_ids) >= self.k:
            at = len(doc_ids) - self.k
            kth = np.partition(scores[unset], at, axis=1)[:, at].astype(np.float64)
            floor[unset] = np.round(kth - error, SCORE_DECIMALS) - MARGIN
            self.floor[rows] = floor
        # Of the flat tile: looking for places in two dimensions takes half as long as the product.
        likely = np.flatnonzero(scores >= (floor - error).astype(np.float32)[:, None])
        at_row, at_doc = np.divmod(likely, len(doc_ids))
        return self._rated(rows[at_row], doc_ids[at_doc], documents, at_doc)

    def offer(
        self, rows: np.ndarray, doc_ids: np.ndarray, documents: np.ndarray, at: np.ndarray
    ) -> None:
        """Offer pairs: queries numbered ``rows``, documents in the rows ``at`` of their matrix."""
        height = max(1, TILE_VALUES // self.queries.shape[1])
        for low in range(0, len(rows), height):
            part = slice(low, low + height)
            self._keep(self._rated(rows[part], doc_ids[part], documents, at[part]))

    def _keep(self, found: tuple[np.ndarray, ...]) -> None:
        self.waiting.append(found)
        self.n_waiting += len(found[0])
        if self.n_waiting > max(65_536, len(self.held[0])):
            self._merge()

    def _rated(self, rows: np.ndarray, docs: np.ndarray, documents: np.ndarray, at: np.ndarray):
        """Exact scores of pairs, ``at`` being the rows of ``documents``; useful ones stay."""
        exact = np.empty(len(rows))
        for low in range(0, len(rows), RATED_PAIRS):
            part = slice(low, low + RATED_PAIRS)
            exact[part] = np.einsum(
                "ij,ij->i", self.queries[rows[part]], documents[at[part]], dtype=np.float64
            )
        values = np.round(exact, SCORE_DECIMALS)
        # Copies of one document tie at the floor; most of them end here.
        useful = (values > self.floor[rows]) | (
            (values == self.floor[rows]) & (docs < self.last_doc[rows])
        )
        return first_k(rows[useful], docs[useful], values[useful], self.k)[:3]

    def _merge(self) -> None:
        parts = zip(*[self.held, *self.waiting])
        rows, docs, scores, rank = first_k(*(np.concatenate(part) for part in parts), self.k)
        self.held, self.waiting, self.n_waiting = (rows, docs, scores), [], 0
        full = rank == self.k - 1
        self.floor[rows[full]] = scores[full]
        self.last_doc[rows[full]] = docs[full]

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._merge()
        rows, docs, scores = self.held
        return self.query_ids[rows], docs, scores


def _batch(query_ids: np.ndarray, docs: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(query_ids, pa.int64()),
            pa.array(docs, pa.int64()),
            pa.array(scores, pa.float64()),
        ],
        names=["query_id", "doc_id", "score"],
    )


def with_floor(queries: DataFrame) -> DataFrame:
    """Queries with the column ``_floor``, NULL where no score is known that k documents reach."""
    if "_floor" in queries.columns:
        return queries
    return queries.withColumn("_floor", F.lit(None).cast("double"))


def _floors(column: pa.Array) -> np.ndarray:
    return column.fill_null(-np.inf).to_numpy(zero_copy_only=False)


def _rows_by_cell(lists: pa.ChunkedArray) -> dict[int, np.ndarray]:
    """For each cell, the numbers of the queries that probe it."""
    lists = lists.combine_chunks()
    cells = lists.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    order = np.argsort(cells, kind="stable")
    found, starts = np.unique(cells[order], return_index=True)
    return dict(zip(found.tolist(), np.split(rows[order], starts[1:])))


def _against_broadcast(
    queries: DataFrame, documents: DataFrame, k: int, dimension: int, probing: bool
) -> DataFrame:
    """Stream the documents past a broadcast query matrix; no shuffle of either."""
    held = with_floor(queries).select("query_id", "embedding", "_cells", "_floor").toArrow()
    by_cell = _rows_by_cell(held.column("_cells"))
    shared = documents.sparkSession.sparkContext.broadcast(
        (
            held.column("query_id").to_numpy(),
            as_matrix(held.column("embedding"), dimension),
            _floors(held.column("_floor").combine_chunks()),
            by_cell,
        )
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, matrix, known, rows_of = shared.value
        best = _BestK(query_ids, matrix, k, known)
        for batch in batches:
            cells = batch.column("_cell").to_numpy(zero_copy_only=False)
            doc_ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            vectors = as_matrix(batch.column("embedding"), dimension, unit=True)
            order = np.argsort(cells, kind="stable")
            found, starts = np.unique(cells[order], return_index=True)
            for cell, here in zip(found.tolist(), np.split(order, starts[1:])):
                if cell in rows_of:
                    best.add(doc_ids[here], vectors[here], rows_of[cell])
        yield _batch(*best.result())

    wanted = documents.select("_cell", "doc_id", "embedding")
    if probing:
        # Lets an index stored by cell skip the files of all other cells. The
        # cells are part of the query lists, whose size has been checked.
        cells = documents.sparkSession.createDataFrame([(c,) for c in by_cell], "_cell int")
        wanted = wanted.join(F.broadcast(cells), "_cell", "left_semi")
    return wanted.mapInArrow(score, PARTIAL_SCHEMA)


def _on_grid(
    queries: DataFrame,
    documents: DataFrame,
    k: int,
    dimension: int,
    query_part_rows: int,
    document_part_rows: int,
) -> DataFrame:
    """Score each cell as a grid of query parts and document parts."""
    probes = with_floor(queries).select(
        F.explode("_cells").alias("_cell"), "query_id", "embedding", "_floor"
    )
    q_count = probes.groupBy("_cell").agg(F.count("*").alias("_nq"))
    d_count = documents.groupBy("_cell").agg(F.count("*").alias("_nd"))

    def parts(n: int, rows: int, most_rows: int) -> int:
        # Rows are copied once per part of the other side: many small parts are many copies.
        return min(-(-n // rows), max(MOST_PARTS, -(-n // most_rows)))

    # One row per cell; the number of cells is a setting, not a data size.
    sizes = [
        (
            c._cell,
            parts(c._nq, query_part_rows, LARGEST_QUERY_PART),
            parts(c._nd, document_part_rows, LARGEST_DOCUMENT_PART),
            c._nq * c._nd,
        )
        for c in q_count.join(d_count, "_cell").collect()
    ]
    # Large pairs of parts come first, so that none is left for the end.
    sizes.sort(key=lambda c: (-c[3] / (c[1] * c[2]), c[0]))
    cells, blocks = [], 0
    for cell, q_parts, d_parts, _ in sizes:
        cells.append((cell, q_parts, d_parts, blocks))
        blocks += q_parts * d_parts
    spark = documents.sparkSession
    worth = max(
        spark.sparkContext.defaultParallelism, -(-sum(c[3] for c in sizes) // TASK_PAIRS)
    )
    tasks = max(1, min(blocks, worth))
    grid = spark.createDataFrame(cells, "_cell int, _q_parts int, _d_parts int, _first int")

    def spread(df: DataFrame, row_id: str, own: str, other: str, side: int) -> DataFrame:
        # Cells without a partner drop out here, before anything is shuffled.
        part = {
            own: F.pmod(F.xxhash64(row_id), F.col(own)).cast("int"),
            other: F.explode(F.sequence(F.lit(0), F.col(other) - F.lit(1))),
        }
        return (
            df.select("_cell", row_id, "embedding", "_floor")
            .join(F.broadcast(grid), "_cell")
            .select("*", part["_q_parts"].alias("_q"), part["_d_parts"].alias("_d"))
            .select(
                (F.col("_first") + F.col("_q") * F.col("_d_parts") + F.col("_d")).alias("_block"),
                F.lit(side).alias("_side"),
                F.col(row_id).alias("_id"),
                "embedding",
                "_floor",
            )
        )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Blocks come one after the other, in each the queries before the documents.
        block, asked, best = None, [], None
        for batch in batches:
            blocks = batch.column("_block").to_numpy()
            sides = batch.column("_side").to_numpy()
            starts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(sides) != 0)) + 1
            for low, high in zip([0, *starts], [*starts, len(blocks)]):
                if low == high:
                    continue
                if blocks[low] != block:
                    if best:
                        yield _batch(*best.result())
                    block, asked, best = blocks[low], [], None
                part = batch.slice(low, high - low)
                ids = part.column("_id").to_numpy(zero_copy_only=False)
                if sides[low] == 0:
                    # Copies: the batch is not kept.
                    matrix = as_matrix(part.column("embedding"), dimension)
                    asked.append((ids.copy(), matrix.copy(), _floors(part.column("_floor")).copy()))
                elif best or asked:
                    if best is None:
                        names, matrix, known = (np.concatenate(x) for x in zip(*asked))
                        best = _BestK(names, matrix, k, known)
                        asked = []
                    vectors = as_matrix(part.column("embedding"), dimension, unit=True)
                    best.add(ids, vectors, np.arange(len(best.query_ids)))
        if best:
            yield _batch(*best.result())

    return (
        spread(probes, "query_id", "_q_parts", "_d_parts", 0)
        .unionByName(spread(with_floor(documents), "doc_id", "_d_parts", "_q_parts", 1))
        .repartitionById(tasks, F.pmod("_block", F.lit(tasks)))
        .sortWithinPartitions("_block", "_side")
        .mapInArrow(score, PARTIAL_SCHEMA)
    )


def whole_parts(spark: SparkSession, queries: int, documents: int, most_rows: int) -> int:
    """Parts of a query set for :func:`over_query_parts`, some for each core if that is worth it."""
    cores = spark.sparkContext.defaultParallelism
    worth = min(2 * cores, -(-queries * documents // TASK_PAIRS))
    parts = max(1, worth, -(-queries // most_rows))
    return parts if parts < cores else -(-parts // cores) * cores


def over_query_parts(
    queries: DataFrame,
    others: list[DataFrame],
    parts: int,
    score: Callable[[Iterator[tuple[int, pa.RecordBatch]]], Iterator[pa.RecordBatch]],
    schema: str,
    order: tuple[str, ...] = (),
) -> DataFrame:
    """Each part of ``queries`` meets all rows of ``others`` in a task of its own.

    All tables have the same columns, the first is the id. ``score`` gets batches of one
    side after the other, with its number: queries (0), then those of ``others``
    (1 and up) as often as they are listed, each by ``order``. A query is in one task
    only, so nothing of what a task finds has to be merged.
    """
    part = F.pmod(F.xxhash64(F.col(queries.columns[0])), F.lit(parts)).cast("int")
    rows = queries.select(F.lit(0).alias("_side"), part.alias("_part"), "*")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    for side, other in enumerate(others, 1):
        rows = rows.unionByName(other.select(F.lit(side).alias("_side"), every.alias("_part"), "*"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def by_side() -> Iterator[tuple[int, pa.RecordBatch]]:
            for batch in batches:
                sides = batch.column(0).to_numpy()
                starts = np.flatnonzero(np.diff(sides)) + 1
                for low, high in zip([0, *starts], [*starts, len(sides)]):
                    if low < high:
                        yield int(sides[low]), batch.slice(low, high - low)

        return score(by_side())

    return (
        rows.repartitionById(parts, F.col("_part"))
        .drop("_part")
        .sortWithinPartitions("_side", *order)
        .mapInArrow(run, schema)
    )


def best_per_query(partial: DataFrame, k: int) -> DataFrame:
    """Merge partial results: rank by score, ties by the lower document id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return (
        partial.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "doc_id", "score")
    )


def kth_scores(rankings: DataFrame, k: int) -> DataFrame:
    """Floors (query_id, _floor) for a search that sees at least the documents of this one."""
    return rankings.filter(F.col("rank") == k).select("query_id", F.col("score").alias("_floor"))


def partial_topk(
    queries: DataFrame,
    documents: DataFrame,
    k: int,
    dimension: int,
    *,
    cells_per_query: int = 1,
    broadcast_bytes: int = BROADCAST_BYTES,
    query_part_rows: int = QUERY_PART_ROWS,
    document_part_rows: int = DOCUMENT_PART_ROWS,
) -> DataFrame:
    """What :func:`topk_in_cells` ranks: the best k of each task, (query_id, doc_id, score)."""
    if k <= 0:
        raise ValueError("k must be positive")
    query_bytes = dimension * 4 + cells_per_query * CELL_BYTES + k * KEPT_BYTES
    if "_floor" in queries.columns:
        query_bytes += FLOOR_BYTES
    if queries.select("query_id").count() * query_bytes <= broadcast_bytes:
        return _against_broadcast(queries, documents, k, dimension, cells_per_query > 1)
    return _on_grid(queries, documents, k, dimension, query_part_rows, document_part_rows)


def topk_in_cells(
    queries: DataFrame, documents: DataFrame, k: int, dimension: int, **settings
) -> DataFrame:
    """Best k documents per query among those in one of its cells.

    ``queries`` holds the array ``_cells`` of at most ``cells_per_query``
    numbers, ``documents`` the number ``_cell``. A query whose cells hold fewer
    than k documents gets fewer rows. ``queries`` may hold ``_floor``, a score that
    k of these documents are known to reach. What a broadcast would carry is counted
    with its cell lists, the index over them and the best that a task keeps.
    ``query_part_rows`` and ``document_part_rows`` hold up to MOST_PARTS parts; a
    larger cell has larger parts, up to LARGEST_QUERY_PART and LARGEST_DOCUMENT_PART.
    """
    return best_per_query(partial_topk(queries, documents, k, dimension, **settings), k)


def exact_topk(
    queries: DataFrame, documents: DataFrame, k: int, dimension: int, **settings
) -> DataFrame:
    """Inner-product top k over the whole document table.

    ``queries(query_id, embedding)`` and ``documents(doc_id, embedding)`` hold
    unit vectors, so the score is the cosine; others fail the job. ``queries`` may
    hold ``_floor``, a score that k documents are known to reach: what is below it
    is left out early. Returns ``(query_id, rank, doc_id, score)``; k above the
    table size returns all.
    """
    require_columns(queries, ["query_id", "embedding"], "the query table")
    require_columns(documents, ["doc_id", "embedding"], "the document table")
    return topk_in_cells(
        check_unit_vectors(queries, dimension).withColumn("_cells", F.array(F.lit(0))),
        documents.withColumn("_cell", F.lit(0)),
        k,
        dimension,
        **settings,
    )
