"""Pair scores and the score used for reranking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citespark.functions.text import word_set

# Fixed value: weight of the answer-quality bonus in the final score.
ANSWER_SCORE_WEIGHT = 0.03


def shared_word_score(query: Column, document: Column) -> Column:
    """Share of the query's distinct words found in the document, 0 to 1."""
    return shared_share(word_set(query), word_set(document))


def shared_share(query_words: Column, document_words: Column) -> Column:
    """Share of the first word set that the second one holds."""
    shared = F.size(F.array_intersect(query_words, document_words))
    return F.when(
        F.size(query_words) > 0, shared.cast("double") / F.size(query_words)
    ).otherwise(F.lit(0.0))


def quality_bonus(answer_score: Column) -> Column:
    return F.log1p(F.greatest(answer_score.cast("double"), F.lit(0.0)))


def final_score(
    pair_score: Column, answer_score: Column, weight: float = ANSWER_SCORE_WEIGHT
) -> Column:
    """Pair score plus the weighted quality bonus; NaN or NULL scores sort last."""
    return F.nanvl(pair_score, F.lit(None).cast("double")) + F.lit(weight) * quality_bonus(answer_score)
