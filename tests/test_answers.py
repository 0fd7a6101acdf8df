import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from citespark.operators.answers import Generation
from citespark.operators import answers, rerank
from citespark.operators.encode import HashedWordEncoder
from citespark.plans import answering

# The fake models below are sent to the workers by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CANDIDATE = (
    "query_id bigint, doc_id bigint, query string, title string, question_body string, "
    "answer string, answer_score int, url string"
)


def length_scorer():
    return lambda pairs: np.array([float(len(document)) for _, document in pairs])


def candidates(spark, rows):
    return spark.createDataFrame(
        [(1, i, "q", t, b, "an answer", s, "u") for i, (t, b, s) in enumerate(rows)], CANDIDATE
    )


def test_rerank_with_a_model(spark):
    rows = candidates(spark, [("A", "short", 10), ("Long title", "much longer body", 0)])
    found = rerank.rerank(rows, 1, length_scorer).first()
    assert (found.title, found.source_rank) == ("Long title", 1)
    assert found.reranker_score == float(len("Long title\nmuch longer body"))


def test_rerank_puts_odd_scores_last(spark):
    scorer = lambda: (lambda pairs: [float("nan") if "bad" in d else 1.0 for _, d in pairs])
    rows = candidates(
        spark, [("bad", "x", 99), ("one", "x", -7), ("two", "x", 0), ("three", "x", None)]
    )
    found = rerank.rerank(rows, 4, scorer, batch_size=2).orderBy("source_rank").collect()
    assert [r.title for r in found] == ["one", "two", "three", "bad"]


def test_rerank_rejects_bad_input(spark):
    rows = candidates(spark, [("A", "short", 10)])
    with pytest.raises(ValueError):
        rerank.rerank(rows, 0)
    with pytest.raises(ValueError):
        rerank.rerank(rows, 1, length_scorer, batch_size=0)
    with pytest.raises(ValueError, match="answer_score"):
        rerank.rerank(rows.drop("answer_score"), 1)
    with pytest.raises(Exception, match="scores"):
        rerank.rerank(rows, 1, lambda: (lambda pairs: [])).collect()


CORPUS = (
    "doc_id bigint, title string, question_body string, answer string, answer_score int, url string"
)


def corpus(spark):
    texts = [
        ("Sort a list", "How do I sort a list of numbers", "Call &lt;sorted&gt;  on the list", 5),
        ("Read a file", "How can a text file be read", "Open the file and read it", 0),
        ("Join strings", "Join many strings with a comma", "Use the join method of str", 2),
    ]
    return spark.createDataFrame(
        [(i, t, b, a, s, f"https://x/{i}") for i, (t, b, a, s) in enumerate(texts)], CORPUS
    )


def test_fetch_keeps_rank_and_cleans(spark):
    results = spark.createDataFrame(
        [(7, 1, 2, 0.9), (7, 2, 0, 0.5), (8, 1, 0, 0.4)],
        "query_id bigint, rank int, doc_id bigint, vector_similarity double",
    )
    found = rerank.fetch_documents(results, corpus(spark)).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id) for r in found] == [(7, 2), (7, 0), (8, 0)]
    assert found[1].answer == "Call <sorted> on the list"
    with pytest.raises(Exception, match="no document with id 99"):
        rerank.fetch_documents(results.withColumn("doc_id", F.lit(99)), corpus(spark)).collect()


SOURCE = (
    "sources array<struct<source_rank int, doc_id bigint, title string, question_body string, "
    "answer string, url string, reranker_score double>>"
)


def sourced(spark, answer, scores=(1.0,), text="Use the implementation provided by the library"):
    sources = [(i + 1, i, "T", "Q" * 800, text, "U", s) for i, s in enumerate(scores)]
    return spark.createDataFrame(
        [(1, "how", answer, sources)], f"query_id bigint, query string, answer string, {SOURCE}"
    )


def test_context_and_prompt(spark):
    rows = sourced(spark, None, (1.0, 0.5), text="A" * 1500)
    text = rows.select(answers.context(F.col("sources"))).first()[0]
    block = "Title: T\nQuestion: " + "Q" * 700 + "\nAnswer: " + "A" * 1400 + "\nURL: U"
    assert text == f"[1]\n{block}\n\n[2]\n{block}"
    prompt = rows.select(answers.user_prompt(F.col("query"), F.col("sources"))).first()[0]
    assert prompt == f"Question:\nhow\n\nSources:\n{text}\n\nWrite the answer."


def test_audit_keeps_a_cited_answer(spark):
    found = answers.audit_answers(sourced(spark, " Use the implementation. [1]\n")).first()
    assert found.answer == "Use the implementation. [1]"
    assert (found.used_fallback, found.citation_coverage, found.citation_validity) == (
        False, 1.0, 1.0)


def test_audit_replaces_an_uncited_answer(spark):
    found = answers.audit_answers(sourced(spark, "This answer has no citation."), 3).first()
    assert found.answer == "Use the implementation ... [1]"
    assert (found.used_fallback, found.citation_validity) == (True, 1.0)


def test_gate_takes_the_first_source(spark):
    """The first source by final score decides, even if another one scores higher."""
    rows = sourced(spark, "x", (0.2, 0.9))
    assert answers.answer_gate(rows, 0.5).first().abstained is True
    assert answers.answer_gate(rows, 0.2).first().abstained is False
    assert answers.answer_gate(sourced(spark, "x", (float("nan"),)), 0.5).first().abstained is False


def test_records(spark):
    kept = answers.answer_records(sourced(spark, "Use the implementation. [1]"), 0.5).first()
    assert (kept.abstained, kept.top_reranker_score) == (False, 1.0)
    gone = answers.answer_records(sourced(spark, "Use it as shown. [1]", (0.1,)), 0.5).first()
    assert (gone.answer, gone.abstained, gone.used_fallback, gone.citation_coverage) == (
        answers.ABSTENTION_TEXT, True, False, None)
    with pytest.raises(Exception, match="must not be empty"):
        answers.answer_records(sourced(spark, "x").withColumn("query", F.lit("  "))).collect()


def test_summary(spark):
    rows = spark.createDataFrame(
        [
            (True, False, 1.0, 1.0, False),
            (True, False, 0.5, 1.0, True),
            (True, True, None, None, False),
            (False, True, None, None, False),
        ],
        "in_domain boolean, abstained boolean, citation_coverage double, "
        "citation_validity double, used_fallback boolean",
    )
    found = answers.answer_summary(rows).first()
    assert (found.queries, found.behaviour_accuracy) == (4, 0.75)
    assert found.in_domain_answer_rate == pytest.approx(2 / 3, abs=1e-6)
    assert found.out_of_domain_abstention_rate == 1.0
    assert (found.citation_coverage, found.citation_validity, found.fallback_rate) == (0.75, 1.0, 0.5)


def echo_generator():
    def generate(prompts):
        # A question that the gate turns away never gets here.
        assert not any("quantum" in user for _, user in prompts)
        return [Generation(f"Answer for {user.splitlines()[1]}. [1]", 7) for _, user in prompts]
    return generate


def test_answering_end_to_end(spark):
    questions = spark.createDataFrame(
        [(1, "sort a list of numbers"), (2, "quantum chromodynamics lattice")],
        "query_id bigint, query string",
    )
    best = answering.retrieve_and_rerank(
        questions, corpus(spark), lambda: HashedWordEncoder(64), 64, n_candidates=3, n_sources=2
    )
    found = {
        r.query_id: r
        for r in answering.answer_questions(
            questions, best, make_generator=echo_generator, system_prompt="Be brief."
        ).collect()
    }
    assert (found[1].prompt_tokens, found[1].output_tokens) == (7, None)
    assert found[1].generation_ms >= 0 and found[2].generation_ms is None
    with pytest.raises(ValueError, match="system prompt"):
        answering.answer_questions(questions, best, make_generator=echo_generator)
    blank = questions.withColumn("query", F.lit(" "))
    with pytest.raises(Exception, match="must not be empty"):
        answering.retrieve_and_rerank(blank, corpus(spark), lambda: HashedWordEncoder(64), 64)
    assert found[1].answer == "Answer for sort a list of numbers. [1]"
    assert [s.doc_id for s in found[1].sources][0] == 0
    assert (found[2].abstained, found[2].answer) == (True, answers.ABSTENTION_TEXT)
    extract = answering.answer_questions(questions, best).filter("query_id = 1").first()
    assert extract.answer == "Call <sorted> on the list [1]"


def test_question_without_sources_abstains(spark):
    questions = spark.createDataFrame([(1, "a"), (2, "b")], "query_id bigint, query string")
    one = spark.createDataFrame(
        [(1, 1, 0, "t", "b", "the answer text", 1, "u", 0.5, 1.0, 1.0)],
        "query_id bigint, source_rank int, doc_id bigint, title string, question_body string, "
        "answer string, answer_score int, url string, vector_similarity double, "
        "reranker_score double, final_score double",
    )
    found = {r.query_id: r.abstained for r in answering.answer_questions(questions, one).collect()}
    assert found == {1: False, 2: True}
