"""Known-item retrieval: encode both sides, search, and rank the right document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.operators.encode import TextEncoder, encode_texts
from citespark.operators.evaluate import known_item_ranks
from citespark.operators.sampling import DEFAULT_SEED, sample_by_key
from citespark.operators.search import exact_topk
from citespark.operators.stable import cut_lineage


def encoded_sides(
    queries: DataFrame,
    documents: DataFrame,
    make_encoder: Callable[[], TextEncoder],
    dimension: int,
) -> tuple[DataFrame, DataFrame]:
    """Vectors of ``queries(query_id, query)`` and ``documents(doc_id, text)``.

    Both are materialised: several searches read them, and encoding is the
    costly step.
    """
    asked = encode_texts(queries, "query", make_encoder, dimension)
    stored = encode_texts(documents, "text", make_encoder, dimension)
    return (
        cut_lineage(asked.select("query_id", "embedding")),
        cut_lineage(stored.select("doc_id", "embedding")),
    )


def known_item_run(
    queries: DataFrame,
    documents: DataFrame,
    relevant: DataFrame,
    make_encoder: Callable[[], TextEncoder],
    dimension: int,
    k: int = 10,
    sample: int | None = None,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """Rank of the relevant document per query under exact search.

    All queries against all documents is quadratic work; ``sample`` takes
    exactly that many queries by sampling key, or fails.
    """
    if sample is not None:
        queries = cut_lineage(sample_by_key(queries, "query_id", sample, seed))
        relevant = relevant.join(queries.select("query_id"), "query_id", "left_semi")
    asked, stored = encoded_sides(queries, documents, make_encoder, dimension)
    # Stored: the checks and the ranks read it, and the search is quadratic.
    rankings = cut_lineage(exact_topk(asked, stored, k, dimension))
    return known_item_ranks(rankings, relevant.select("query_id", "relevant_doc_id")).join(
        queries.select("query_id", F.col("query")), "query_id"
    )
