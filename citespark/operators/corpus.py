"""Question-answer corpus: best answer per question, clean text, dense ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citespark.functions.text import id_from_text, score_from_text, strip_html
from citespark.operators.joins import join_to_unique
from citespark.operators.sampling import (
    DEFAULT_SEED,
    dense_row_id,
    find_cut,
    sample_by_key,
    up_to_cut,
)
from citespark.operators.stable import cut_lineage, require_columns

# Fixed value: questions are cited under this address.
URL_PREFIX = "https://stackoverflow.com/questions/"

CORPUS_COLUMNS = [
    "doc_id",
    "question_id",
    "answer_id",
    "title",
    "question_body",
    "answer",
    "question_score",
    "answer_score",
    "url",
]


def typed_answers(answers: DataFrame) -> DataFrame:
    """Answers as ids, score and HTML; rows with a missing field are dropped."""
    require_columns(answers, ["Id", "ParentId", "Score", "Body"], "the answer table")
    present = F.col("ParentId").isNotNull() & F.col("Id").isNotNull() & F.col("Body").isNotNull()
    return answers.filter(present).select(
        id_from_text(F.col("ParentId")).alias("question_id"),
        id_from_text(F.col("Id")).alias("answer_id"),
        score_from_text(F.col("Score")).alias("answer_score"),
        F.col("Body").alias("answer_html"),
    )


def typed_questions(questions: DataFrame) -> DataFrame:
    """Questions as id, score and HTML; rows with a missing field are dropped."""
    require_columns(questions, ["Id", "Score", "Title", "Body"], "the question table")
    present = F.col("Id").isNotNull() & F.col("Title").isNotNull() & F.col("Body").isNotNull()
    return questions.filter(present).select(
        id_from_text(F.col("Id")).alias("question_id"),
        score_from_text(F.col("Score")).alias("question_score"),
        F.col("Title").alias("title_html"),
        F.col("Body").alias("question_html"),
    )


def first_per_group(df: DataFrame, group: list[str], order: list) -> DataFrame:
    """First row of each group in the given order.

    Spark limits the rank before and after the shuffle, so a group with a third
    of all rows sends one row per map task.
    """
    window = Window.partitionBy(*group).orderBy(*order)
    return (
        df.withColumn("_place", F.row_number().over(window))
        .filter(F.col("_place") == 1)
        .drop("_place")
    )


def best_answers(answers: DataFrame) -> DataFrame:
    """Highest-scored answer per question, ties to the lower answer id."""
    return first_per_group(
        answers,
        ["question_id"],
        [
            F.desc_nulls_last("answer_score"),
            F.asc_nulls_last("answer_id"),
            F.asc("answer_html"),
        ],
    )


def build_corpus(
    questions: DataFrame,
    answers: DataFrame,
    n: int | None = None,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """Answered questions with their best answer, numbered in sampling order.

    With ``n`` exactly that many rows are kept, or the job fails. The cut is
    found on the ids alone and applied to both inputs first, so only the sample
    and little more is shuffled with its text.
    """
    asked, given = typed_questions(questions), typed_answers(answers)
    cut = None
    if n is not None:
        answered = asked.select("question_id").join(
            given.select("question_id").distinct(), "question_id", "left_semi"
        )
        cut = find_cut(answered, "question_id", n, seed)
        asked = up_to_cut(asked, "question_id", cut, seed)
        given = up_to_cut(given, "question_id", cut, seed)
    rows = join_to_unique(asked, best_answers(given), "question_id").select(
        "question_id",
        "answer_id",
        strip_html(F.col("title_html")).alias("title"),
        strip_html(F.col("question_html")).alias("question_body"),
        strip_html(F.col("answer_html")).alias("answer"),
        "question_score",
        "answer_score",
        F.concat(F.lit(URL_PREFIX), F.col("question_id").cast("string")).alias("url"),
    )
    if cut is not None:
        rows = sample_by_key(cut_lineage(rows), "question_id", n, seed, cut)
    return dense_row_id(rows, "question_id", seed).select(*CORPUS_COLUMNS)


def corpus_stats(corpus: DataFrame) -> DataFrame:
    """Row count and rounded means of text lengths and scores."""
    return corpus.agg(
        F.count("*").alias("objects"),
        F.round(F.avg(F.length("title")), 2).alias("title_chars_mean"),
        F.round(F.avg(F.length("question_body")), 2).alias("body_chars_mean"),
        F.round(F.avg(F.length("answer")), 2).alias("answer_chars_mean"),
        F.round(F.avg("question_score"), 3).alias("question_score_mean"),
        F.round(F.avg("answer_score"), 3).alias("answer_score_mean"),
    )
