"""Packing documents into sequences along a space-filling curve.

The ids of a document are hashed into a vector of bucket counts, whose random
projection has four coordinates. Documents are sorted by the Hilbert key of
these coordinates, so that neighbours in the order hold like text. Their ids,
laid end to end in that order, are cut every ``length`` ids. What remains at
the end is cut into sequences whose lengths are powers of two, so no sequence
needs padding.

Only narrow rows (key, id, number of ids) are range-sorted. Their running sum
tells where the ids of a document begin, and with that a document is cut on its
own: its ids meet their place in one join on a unique row number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citespark.llm.bpe import spread
from citespark.llm.staging import per_worker, stored
from citespark.llm.token_shards import LibraryEncoder, mix

BUCKETS = 1_024
DIMENSIONS = 4
#: Bits of a coordinate; the key has DIMENSIONS times as many.
BITS = 15
#: Coordinates further from the mean than this many deviations share the last cell.
REACH = 3.0
ROWS_AT_ONCE = 1_024
#: Documents in a range of the narrow sort.
SORT_ROWS = 1_000_000
PIECE = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, " \
    "sequence_id bigint, offset bigint"


def projection() -> np.ndarray:
    """The random matrix from buckets to coordinates, from a fixed seed."""
    return np.random.default_rng(13).standard_normal((BUCKETS, DIMENSIONS))


def coordinates(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One row of coordinates per document; zeros without ids.

    Square roots of the bucket shares make a unit vector in which frequent ids
    don't drown the others.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    known = np.arange(1 + (int(tokens.max()) if len(tokens) else 0))
    bucket = (mix(known, 5) % np.uint64(BUCKETS)).astype(np.int64)[tokens]
    counts = np.bincount(owner * BUCKETS + bucket, minlength=len(sizes) * BUCKETS)
    shares = counts.reshape(len(sizes), BUCKETS) / np.maximum(sizes, 1)[:, None]
    # Without the matrix library, whose threads would spin beside the other tasks.
    return np.einsum("db,bk->dk", np.sqrt(shares), projection())


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells``, integers below 2 ** bits.

    From the coarsest bit on, each level mirrors or exchanges the axes of the
    levels below as the curve turns; a Gray code then orders the cells.
    """
    axes = [column.astype(np.int64) for column in cells.T]
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for i, axis in enumerate(axes):
            upper = (axis >> level) & 1 == 1
            swap = np.where(upper, 0, (axes[0] ^ axis) & below)
            axes[0] = np.where(upper, axes[0] ^ below, axes[0] ^ swap)
            if i:
                axes[i] = axis ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros(len(cells), dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((axes[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    key = np.zeros(len(cells), dtype=np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = key << 1 | ((axis ^ turn) >> level) & 1
    return key


def _encoded(rows: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, uid, point, n_tokens, ids (in the width of the vocabulary, with the end id).

    ``uid`` numbers the rows, the same for every attempt of a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(("LibraryEncoder", tokenizer), lambda: LibraryEncoder(tokenizer))
        kind = f"<u{encoder.width}"
        uid = TaskContext.get().partitionId() << 33
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                tokens, sizes = encoder.encode_flat(batch.column(1).to_pylist())
                points = coordinates(tokens, sizes)
                with_end = np.insert(tokens, np.cumsum(sizes), end_id).astype(kind)
                ends = np.cumsum(sizes + 1)
                ids = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(),
                    len(sizes),
                    [
                        None,
                        pa.py_buffer(np.append(0, ends * encoder.width).astype(np.int64)),
                        pa.py_buffer(with_end),
                    ],
                )
                yield pa.record_batch(
                    [
                        batch.column(0),
                        pa.array(np.arange(uid, uid + len(sizes))),
                        pa.FixedSizeListArray.from_arrays(
                            pa.array(points.ravel()), DIMENSIONS
                        ).cast(pa.list_(pa.float64())),
                        pa.array(sizes + 1),
                        ids.cast(pa.binary()),
                    ],
                    names=["doc_id", "uid", "point", "n_tokens", "ids"],
                )
                uid += len(sizes)

    return rows.mapInArrow(
        run, "doc_id bigint, uid bigint, point array<double>, n_tokens bigint, ids binary"
    )


def _with_keys(encoded: DataFrame) -> DataFrame:
    """``encoded`` with the Hilbert key: coordinates are centred and scaled over all documents."""
    moments = encoded.agg(
        *[F.avg(F.col("point")[i]) for i in range(DIMENSIONS)],
        *[F.stddev_pop(F.col("point")[i]) for i in range(DIMENSIONS)],
    ).first()
    centre = np.array([m or 0.0 for m in moments[:DIMENSIONS]])
    scale = np.array([m or 1.0 for m in moments[DIMENSIONS:]])

    @F.arrow_udf("bigint")
    def key(points: pa.Array) -> pa.Array:
        values = np.asarray(points.flatten()).reshape(-1, DIMENSIONS)
        spread_out = ((values - centre) / scale / REACH + 1) / 2 * (1 << BITS)
        cells = np.clip(np.floor(spread_out), 0, (1 << BITS) - 1).astype(np.int64)
        return pa.array(hilbert_keys(cells, BITS))

    return encoded.withColumn("key", key("point")).drop("point")


def _places(keyed: DataFrame, documents: int) -> DataFrame:
    """uid, and the ids before the document in the order along the curve.

    A group of copies has one key; ids and row numbers divide it further.
    """
    order = ["key", F.asc_nulls_first("doc_id"), "uid"]
    ranged = (
        keyed.select("key", "doc_id", "uid", "n_tokens")
        .repartitionByRange(max(1, -(-documents // SORT_ROWS)), *order)
        .sortWithinPartitions(*order)
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        before = 0
        for batch in batches:
            sizes = batch.column(3).to_numpy()
            inside = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            yield pa.record_batch(
                [pa.array(np.full(len(sizes), task)), pa.array(inside), *batch.columns],
                names=["task", "inside", *batch.schema.names],
            )

    placed = stored(
        ranged.mapInArrow(
            number,
            "task bigint, inside bigint, key bigint, doc_id bigint, uid bigint, n_tokens bigint",
        ),
        "order",
    )
    # One row per range of SORT_ROWS documents.
    before = F.sum("ids_in").over(
        Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    )
    starts = (
        placed.groupBy("task").agg(F.sum("n_tokens").alias("ids_in"))
        .select("task", F.coalesce(before, F.lit(0)).alias("task_start"))
    )
    return placed.join(F.broadcast(starts), "task").select(
        "uid", (F.col("task_start") + F.col("inside")).alias("at")
    )


def tail_ends(total: int, length: int) -> np.ndarray:
    """Ends of the sequences that hold the last ``total % length`` ids: powers of two."""
    rest = total % length
    parts = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return total - rest + np.cumsum(np.array(parts, dtype=np.int64))


def cut_pieces(
    starts: np.ndarray, sizes: np.ndarray, total: int, length: int
) -> tuple[np.ndarray, ...]:
    """Pieces of runs of ids: run, ids of the run before it, size, sequence, place in it."""
    tail = tail_ends(total, length)
    tail_start = total - total % length
    ends = starts + sizes
    # Cuts strictly inside a run: multiples of the length, then ends of the tail.
    first = np.minimum(starts // length + 1, tail_start // length + 1)
    last = np.minimum((ends - 1) // length, tail_start // length)
    plain = np.maximum(last - first + 1, 0)
    low, high = np.searchsorted(tail, starts, "right"), np.searchsorted(tail, ends, "left")
    more = np.maximum(high - low, 0)
    run = np.arange(len(starts))
    cuts = np.concatenate(
        [starts, spread(first, plain) * length, tail[spread(low, more)] if len(tail) else tail]
    )
    owner = np.concatenate([run, np.repeat(run, plain), np.repeat(run, more)])
    order = np.lexsort((cuts, owner))
    cuts, owner = cuts[order], owner[order]
    is_last = np.append(owner[1:] != owner[:-1], True)
    size = np.where(is_last, ends[owner], np.append(cuts[1:], 0)) - cuts
    at = np.searchsorted(tail, cuts, "right")
    in_tail = cuts >= tail_start
    sequence = np.where(in_tail, tail_start // length + at, cuts // length)
    tail_starts = np.append(tail_start, tail)
    offset = np.where(in_tail, cuts - tail_starts[np.where(in_tail, at, 0)], cuts % length)
    return owner, cuts - starts[owner], size, sequence, offset


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    length: int = 2_048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces of the documents' ids in sequences of ``length`` ids, like texts side by side.

    Returns doc_id, start (ids of its document before the piece), length, ids
    (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset. The ids of
    a document end with ``end_id``. All sequences are full but those of the last
    ``total % length`` ids, whose lengths are powers of two.

    A null or empty text has the end id only. Null ids are documents like
    others, first among equal keys; rows that repeat an id are documents of
    their own. A long text spans many sequences. Other columns are ignored; an
    empty table gives no piece. Ids and the order are stored, so a lost executor
    changes neither.
    """
    if length < 1:
        raise ValueError("length must be positive")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    encoded = stored(_encoded(rows, tokenizer, end_id), "encoded")
    keyed = _with_keys(encoded)
    documents, total = keyed.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    # Row numbers are unique on both sides, so no key is hot.
    placed = encoded.join(_places(keyed, documents), "uid")
    placed = placed.select("doc_id", "at", "n_tokens", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for row in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(row, ROWS_AT_ONCE)
                at, sizes = batch.column(1).to_numpy(), batch.column(2).to_numpy()
                contents = batch.column(3).to_pylist()
                width = len(contents[0]) // int(sizes[0])
                ids = np.frombuffer(b"".join(contents), dtype=f"<u{width}").astype("<u4")
                owner, start, size, sequence, offset = cut_pieces(at, sizes, total, length)
                # Pieces come in the order of the ids.
                ends = np.append(0, np.cumsum(size)) * 4
                pieces = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(),
                    len(size),
                    [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)],
                )
                yield pa.record_batch(
                    [
                        batch.column(0).take(pa.array(owner)),
                        pa.array(start),
                        pa.array(size),
                        pieces.cast(pa.binary()),
                        pa.array(sizes[owner]),
                        pa.array(sequence),
                        pa.array(offset),
                    ],
                    names=[
                        "doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset",
                    ],
                )

    return placed.mapInArrow(cut, PIECE)
