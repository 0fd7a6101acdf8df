"""Fetch candidate documents, score pairs and keep the best sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citespark.functions.scoring import (
    ANSWER_SCORE_WEIGHT,
    final_score,
    shared_share,
    shared_word_score,
)
from citespark.functions.text import clean_text, word_set
from citespark.operators.joins import ROWS_PER_COPY, join_to_unique, rows_per_key
from citespark.operators.stable import require_columns, run_once
from citespark.sources.ranged import RangedTable

# Candidates retrieved per query and sources kept.
CANDIDATES = 40
SOURCES = 3

# Most ids to broadcast: 8 bytes each, some tens of MiB with their hash table.
BROADCAST_IDS = 2_000_000

# Scores a list of (query, document) pairs.
PairScorer = Callable[[list[tuple[str, str]]], np.ndarray]


def fetch_documents(
    results: DataFrame,
    corpus: DataFrame | RangedTable,
    rows_per_copy: int = ROWS_PER_COPY,
    with_words: bool = False,
) -> DataFrame:
    """Join ranked ids to their documents and clean the texts.

    The corpus is first cut down to the documents asked for, so each text is
    cleaned once however often it was retrieved. Up to BROADCAST_IDS distinct
    ids, found by counting, that filter needs no shuffle of the corpus. A corpus
    stored in ranges of ids is read only where the ids lie. Pass ``results`` as
    a stored table, since it is read for the ids as well.

    ``with_words`` adds ``_document_words``, the distinct words that pairs are
    scored by, found once per document and not once per pair.

    An id that the corpus lacks fails the job. A document that very many
    queries retrieved is copied, so that its rows spread over many tasks.
    """
    require_columns(corpus, ["doc_id", "title", "question_body", "answer"], "the corpus")
    counts = rows_per_key(results, "doc_id")
    asked = counts.select("doc_id")
    if isinstance(corpus, RangedTable):
        found = corpus.look_up(asked, BROADCAST_IDS)
    else:
        if asked.count() <= BROADCAST_IDS:
            asked = F.broadcast(asked)
        found = corpus.join(asked, "doc_id", "left_semi")
    known = found.withColumns(
        {
            **{t: clean_text(F.col(t)) for t in ("title", "question_body", "answer")},
            "_known": F.lit(True),
        }
    )
    if with_words:
        document = pair_document(F.col("title"), F.col("question_body"))
        known = known.withColumn("_document_words", word_set(document))
    checked = F.when(F.col("_known"), F.col("doc_id")).otherwise(
        F.raise_error(F.concat(F.lit("no document with id "), F.col("doc_id").cast("string")))
    )
    joined = join_to_unique(results, known, "doc_id", "left", rows_per_copy, counts)
    return joined.withColumn("doc_id", checked).drop("_known")


def pair_document(title: Column, body: Column) -> Column:
    """Document side of a pair: title and body on two lines."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit("")))


def model_score(
    query: Column,
    document: Column,
    make_scorer: Callable[[], PairScorer],
    batch_size: int = 32,
) -> Column:
    """Pair score from a user-supplied model, built once per task."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")

    @F.arrow_udf("double")
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        scorer = make_scorer()
        for queries, documents in batches:
            scores: list[float] = []
            for start in range(0, len(queries), batch_size):
                sides = (queries, documents)
                part = list(zip(*(side.slice(start, batch_size).to_pylist() for side in sides)))
                found = np.asarray(scorer(part), dtype=np.float64).ravel()
                if len(found) != len(part):
                    raise ValueError(f"{len(part)} pairs got {len(found)} scores")
                scores.extend(found)
            yield pa.array(scores, pa.float64())

    return run_once(score)(query, document)


def score_pairs(
    candidates: DataFrame,
    make_scorer: Callable[[], PairScorer] | None = None,
    batch_size: int = 32,
) -> DataFrame:
    """Add ``reranker_score``: the model's, or the share of shared words.

    Word sets that came with the documents are used and dropped.
    """
    require_columns(candidates, ["query", "title", "question_body"], "the candidate table")
    document = pair_document(F.col("title"), F.col("question_body"))
    if make_scorer is not None:
        score = model_score(F.col("query"), document, make_scorer, batch_size)
    elif "_document_words" in candidates.columns:
        score = shared_share(word_set(F.col("query")), F.col("_document_words"))
    else:
        score = shared_word_score(F.col("query"), document)
    return candidates.withColumn("reranker_score", score).drop("_document_words")


def score_candidates(
    candidates: DataFrame,
    make_scorer: Callable[[], PairScorer] | None = None,
    batch_size: int = 32,
    answer_score_weight: float = ANSWER_SCORE_WEIGHT,
) -> DataFrame:
    """Add ``reranker_score`` and, with the quality bonus, ``final_score``."""
    require_columns(candidates, ["query_id", "doc_id", "answer_score"], "the candidate table")
    return score_pairs(candidates, make_scorer, batch_size).withColumn(
        "final_score",
        final_score(F.col("reranker_score"), F.col("answer_score"), answer_score_weight),
    )


def best_sources(scored: DataFrame, top_k: int = SOURCES) -> DataFrame:
    """Keep the ``top_k`` rows per query by final score, as ``source_rank`` 1..k.

    Missing scores come last, ties go to the lower document id.
    """
    if top_k <= 0:
        raise ValueError("top_k must be positive")
    order = Window.partitionBy("query_id").orderBy(
        F.desc_nulls_last("final_score"), F.asc("doc_id")
    )
    return scored.withColumn("source_rank", F.row_number().over(order)).filter(
        F.col("source_rank") <= top_k
    )


def rerank(
    candidates: DataFrame,
    top_k: int = SOURCES,
    make_scorer: Callable[[], PairScorer] | None = None,
    batch_size: int = 32,
    answer_score_weight: float = ANSWER_SCORE_WEIGHT,
) -> DataFrame:
    """Score candidates that carry their texts and keep the best per query."""
    return best_sources(
        score_candidates(candidates, make_scorer, batch_size, answer_score_weight), top_k
    )
