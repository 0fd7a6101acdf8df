"""Text encoding as a job over a table, with pluggable and built-in encoders."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citespark.functions.text import NOT_A_WORD
from citespark.functions.vectors import UNIT_TOLERANCE, as_arrow
from citespark.operators.stable import run_once, spread_small_table

# Turns a list of texts into one row of floats per text.
TextEncoder = Callable[[list[str]], np.ndarray]

# Words whose slots a task remembers.
KNOWN_WORDS = 131_072
_WORD = re.compile(r"[^\W_]+")


class HashedWordEncoder:
    """Word counts, each word counted in a slot given by its MD5, unit length.

    Counts may be weighted by slot. One constant is added to slot 0 so that a
    text without words still has a direction. A task hashes a word once, as long
    as it is remembered.
    """

    def __init__(self, dimension: int = 256, weights: np.ndarray | None = None) -> None:
        if not 0 < dimension <= 65_536:
            raise ValueError("the dimension must be between 1 and 65536")
        self.dimension = dimension
        self.weights = np.ones(dimension) if weights is None else weights
        self.name = f"hashed-words-{dimension}"
        self._known: dict[str, int] = {}

    def slots(self, text: str) -> list[int]:
        """The slot of each word of a text."""
        known = self._known
        if len(known) > KNOWN_WORDS:
            known.clear()
        found = []
        for word in _WORD.findall(text.lower()):
            slot = known.get(word)
            if slot is None:
                digest = hashlib.md5(word.encode()).hexdigest()
                slot = known[word] = int(digest[:4], 16) % self.dimension
            found.append(slot)
        return found

    def __call__(self, texts: list[str]) -> np.ndarray:
        counts = np.zeros((len(texts), self.dimension))
        for row, text in enumerate(texts):
            slots = self.slots(text)
            if slots:
                counts[row] = np.bincount(slots, minlength=self.dimension)
        counts *= self.weights
        counts[:, 0] += 1.0
        return counts / np.linalg.norm(counts, axis=1, keepdims=True)


def _checked(vectors: np.ndarray, rows: int, dimension: int) -> np.ndarray:
    vectors = np.asarray(vectors, dtype=np.float32)
    if vectors.shape != (rows, dimension):
        raise ValueError(f"the encoder returned {vectors.shape}, not {(rows, dimension)}")
    if not np.isfinite(vectors).all():
        raise ValueError("the encoder returned numbers that are not finite")
    if rows and np.abs(np.linalg.norm(vectors, axis=1) - 1.0).max() > UNIT_TOLERANCE:
        raise ValueError("the encoder returned vectors that are not of unit length")
    return vectors


def encoded(
    text: Column,
    make_encoder: Callable[[], TextEncoder],
    dimension: int,
    batch_size: int = 256,
) -> Column:
    """Embedding of a text column; the encoder is built once per task.

    NULL counts as the empty text. What the encoder returns is checked for
    shape, finite numbers and unit length.
    """
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")

    @F.arrow_udf("array<float>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = make_encoder()
        for batch in batches:
            vectors = np.empty((len(batch), dimension), dtype=np.float32)
            for start in range(0, len(batch), batch_size):
                part = [text or "" for text in batch.slice(start, batch_size).to_pylist()]
                vectors[start : start + len(part)] = _checked(encoder(part), len(part), dimension)
            yield as_arrow(vectors)

    return run_once(encode)(text)


def encode_texts(
    df: DataFrame,
    text_column: str,
    make_encoder: Callable[[], TextEncoder],
    dimension: int,
    batch_size: int = 256,
    into: str = "embedding",
) -> DataFrame:
    return spread_small_table(df).withColumn(
        into, encoded(F.col(text_column), make_encoder, dimension, batch_size)
    )


@dataclass(frozen=True)
class TfidfModel:
    """Weights of the word slots: ``ln((documents + 1) / (documents with the slot + 1))``."""

    text_column: str
    weights: np.ndarray

    def encoder(self) -> TextEncoder:
        return HashedWordEncoder(len(self.weights), self.weights)


def word_slots(text: Column, dimension: int) -> Column:
    """Slot of each word of a text, as :class:`HashedWordEncoder` numbers them, in the JVM."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_A_WORD), "")
    return F.transform(
        words,
        lambda w: (F.conv(F.substring(F.md5(w.cast("binary")), 1, 4), 16, 10).cast("int") % dimension),
    )


def counted_slots(slots: Column, weights: np.ndarray) -> Column:
    """Unit vectors of weighted slot counts, a batch of texts at a time."""
    dimension = len(weights)

    @F.arrow_udf("array<float>")
    def count(column: pa.Array) -> pa.Array:
        rows = np.repeat(
            np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False)
        )
        flat = column.flatten().to_numpy(zero_copy_only=False)
        counts = np.bincount(rows * dimension + flat, minlength=len(column) * dimension)
        vectors = counts.reshape(len(column), dimension) * weights
        vectors[:, 0] += 1.0
        return as_arrow(vectors / np.linalg.norm(vectors, axis=1, keepdims=True))

    return run_once(count)(slots)


def encode_hashed(
    df: DataFrame, text_column: str, weights: np.ndarray, into: str = "embedding"
) -> DataFrame:
    """The vectors of :class:`HashedWordEncoder` without a Python loop over texts or words."""
    slots = word_slots(F.col(text_column), len(weights))
    return spread_small_table(df).withColumn(into, counted_slots(slots, weights))


def tfidf_model(df: DataFrame, text_column: str, dimension: int = 1024) -> TfidfModel:
    """Fit the built-in TF-IDF encoder on a text column; NULL counts as the empty text.

    A text adds one to each of its slots and to the number of texts. Sums are
    combined in the tasks, so at most ``dimension`` + 1 rows a task are shuffled.
    """
    slots = F.array_distinct(word_slots(F.col(text_column), dimension))
    counted = (
        spread_small_table(df.select(text_column))
        .select(F.explode(F.array_append(slots, F.lit(dimension))).alias("slot"))
        .groupBy("slot").agg(F.count("*").alias("n"))
    )
    seen = np.zeros(dimension + 1)
    for row in counted.collect():
        seen[row["slot"]] = row["n"]
    return TfidfModel(text_column, np.log((seen[-1] + 1) / (seen[:-1] + 1)))


def encode_tfidf(df: DataFrame, model: TfidfModel) -> DataFrame:
    """Add one TF-IDF vector of unit length per text.

    The constant of :class:`HashedWordEncoder` keeps a text without words, or
    with none but words of all documents, from having no direction.
    """
    return encode_hashed(df, model.text_column, model.weights)


def pending_rows(df: DataFrame, done: DataFrame, id_column: str) -> DataFrame:
    """Rows that have no result yet."""
    return df.join(done.select(id_column).distinct(), id_column, "left_anti")
