"""Answer a table of questions: search, rerank, gate, draft, audit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.operators.answers import (
    ANSWER_WORDS,
    ANSWERABILITY_THRESHOLD,
    Generator,
    GENERATION,
    answer_gate,
    answer_records,
    checked_query,
    generated,
    nest_sources,
    user_prompt,
)
from citespark.operators.encode import TextEncoder
from citespark.operators.joins import join_to_unique
from citespark.operators.project import Projection, project
from citespark.operators.rerank import (
    CANDIDATES,
    SOURCES,
    PairScorer,
    best_sources,
    fetch_documents,
    score_candidates,
)
from citespark.operators.search import exact_topk
from citespark.operators.stable import cut_lineage
from citespark.plans.answer_store import answers_from_store, prompt_digest
from citespark.plans.known_item import encoded_sides


# Searches (queries, documents, k, dimension); exact unless told otherwise.
Search = Callable[[DataFrame, DataFrame, int, int], DataFrame]


def nearest_documents(
    questions: DataFrame,
    corpus: DataFrame,
    make_encoder: Callable[[], TextEncoder],
    dimension: int,
    projection: Projection | None = None,
    n_candidates: int = CANDIDATES,
    search: Search = exact_topk,
) -> DataFrame:
    """Ids of the documents whose question bodies are nearest to each question.

    The ranking is written, so that the costly steps after it start from a
    table of ids and not from the search.
    """
    documents = corpus.select("doc_id", F.col("question_body").alias("text"))
    # An empty question fails here, before anything costly runs.
    asked = questions.select("query_id", checked_query(F.col("query")).alias("query"))
    asked, stored = encoded_sides(asked, documents, make_encoder, dimension)
    if projection is not None:
        asked = cut_lineage(project(asked, projection))
        stored = cut_lineage(project(stored, projection))
        dimension = projection.output_dimension
    nearest = cut_lineage(search(asked, stored, n_candidates, dimension))
    return nearest.withColumnRenamed("score", "vector_similarity")


def with_texts(nearest: DataFrame, questions: DataFrame, corpus: DataFrame) -> DataFrame:
    """Candidates with the texts of both sides.

    The short questions join the ids first, so that the long document texts are
    not shuffled again.
    """
    asked = nearest.join(questions.select("query_id", "query"), "query_id")
    return fetch_documents(cut_lineage(asked), corpus, with_words=True)


def retrieve_and_rerank(
    questions: DataFrame,
    corpus: DataFrame,
    make_encoder: Callable[[], TextEncoder],
    dimension: int,
    projection: Projection | None = None,
    n_candidates: int = CANDIDATES,
    n_sources: int = SOURCES,
    make_scorer: Callable[[], PairScorer] | None = None,
    search: Search = exact_topk,
) -> DataFrame:
    """The best sources per question, numbered by ``source_rank``.

    Candidates are scored where the corpus join leaves them. Only their scores
    are shuffled to be ranked, and only the few winners meet their texts again.
    The winners are written first, so that no pair is scored twice.
    """
    nearest = nearest_documents(
        questions, corpus, make_encoder, dimension, projection, n_candidates, search
    )
    scored = score_candidates(with_texts(nearest, questions, corpus), make_scorer)
    slim = scored.select(
        "query_id", "doc_id", "vector_similarity", "reranker_score", "final_score"
    )
    return fetch_documents(cut_lineage(best_sources(slim, n_sources)), corpus)


def sourced_questions(questions: DataFrame, reranked: DataFrame) -> DataFrame:
    """Every question with its array of sources, empty when nothing was found."""
    nested = nest_sources(reranked)
    empty = F.array().cast(nested.schema["sources"].dataType)
    return questions.join(nested, "query_id", "left").withColumn(
        "sources", F.coalesce("sources", empty)
    )


def answer_questions(
    questions: DataFrame,
    reranked: DataFrame,
    drafts: DataFrame | None = None,
    make_generator: Callable[[], Generator] | None = None,
    threshold: float = ANSWERABILITY_THRESHOLD,
    maximum_words: int = ANSWER_WORDS,
    system_prompt: str | None = None,
    store: str | None = None,
    model_name: str = "generator",
) -> DataFrame:
    """Answer records from a table of drafts or from a generator.

    Without either, every answered question gets the extract of its first
    source. A generator needs the caller's ``system_prompt``. It sees only the
    questions that pass the gate; their records also have the token counts and
    the time of the generation, null for the others. With a ``store`` folder
    answers are kept under a digest of ``model_name`` and prompt, so a run that
    failed is taken up and no prompt is asked twice.
    """
    rows = sourced_questions(
        questions.withColumn("query", checked_query(F.col("query"))), reranked
    )
    if drafts is not None:
        rows = rows.join(drafts.select("query_id", "answer"), "query_id", "left")
    elif make_generator is not None:
        if not system_prompt:
            raise ValueError("a generator needs a system prompt")
        # Stored: the generator must run once per question that passes the gate.
        gated = cut_lineage(answer_gate(rows, threshold))
        prompt = user_prompt(F.col("query"), F.col("sources"))
        asked = gated.filter(~F.col("abstained"))
        if store is None:
            asked = asked.withColumn(
                "_made", generated(F.lit(system_prompt), prompt, make_generator)
            )
        else:
            system = F.lit(system_prompt)
            asked = asked.withColumn("_digest", prompt_digest(model_name, system, prompt))
            prompts = asked.select(
                F.col("_digest").alias("digest"), system.alias("system"), prompt.alias("user")
            )
            found = answers_from_store(prompts, store, make_generator, model_name)
            made = F.struct("answer", "prompt_tokens", "output_tokens", "generation_ms")
            found = found.select(F.col("digest").alias("_digest"), made.cast(GENERATION).alias("_made"))
            asked = join_to_unique(asked, found, "_digest").drop("_digest")
        silent = gated.filter("abstained").withColumn("_made", F.lit(None).cast(GENERATION))
        rows = cut_lineage(
            asked.unionByName(silent)
            .select("*", "_made.*")
            .drop("_made", "abstained", "top_reranker_score")
        )
    else:
        rows = rows.withColumn("answer", F.lit(""))
    return answer_records(rows, threshold, maximum_words)
