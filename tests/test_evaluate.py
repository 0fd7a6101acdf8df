import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from citespark.operators import calibrate, evaluate
from citespark.operators.project import folding
from citespark.operators.search import exact_topk
from citespark.plans.compare import compare_retrievers
from tests_support import table, unit


def ranking(spark, lists):
    rows = [(q, r, d) for q, docs in enumerate(lists) for r, d in enumerate(docs, 1)]
    return spark.createDataFrame(rows, "query_id bigint, rank int, doc_id bigint")


def relevance(spark, docs):
    return spark.createDataFrame(list(enumerate(docs)), "query_id bigint, relevant_doc_id bigint")


RANKED = [(5, 3, 8), (2, 6, 1), (9, 4, 7), (3, 5, 2)]
WANTED = [5, 6, 7, 0]


def test_ranks_and_metrics(spark):
    ranks = evaluate.known_item_ranks(ranking(spark, RANKED), relevance(spark, WANTED))
    assert [r["rank"] for r in ranks.orderBy("query_id").collect()] == [1, 2, 3, 0]
    found = evaluate.known_item_metrics(ranks, recall_ks=(3, 1, 2, 2), metric_cutoff=3).first()
    assert (found.queries, found.recall_at_1, found.recall_at_2, found.recall_at_3) == (
        4, 0.25, 0.5, 0.75)
    assert found.mrr_at_3 == pytest.approx((1 + 1 / 2 + 1 / 3) / 4, abs=1e-6)
    assert found.ndcg_at_3 == pytest.approx((1 + 1 / math.log2(3) + 1 / 2) / 4, abs=1e-6)


def test_mismatched_rankings_and_labels(spark):
    with pytest.raises(ValueError, match="no labelled query"):
        evaluate.known_item_ranks(ranking(spark, RANKED), relevance(spark, [5]))
    twice = relevance(spark, [5, 6]).unionByName(relevance(spark, [6]))
    with pytest.raises(ValueError, match="more than one relevant"):
        evaluate.known_item_ranks(ranking(spark, RANKED[:2]), twice)
    nothing = spark.createDataFrame([], "label int, score double")
    with pytest.raises(ValueError, match="no labelled score"):
        calibrate.best_threshold(nothing, "label", "score")


def test_first_match_wins_and_empty_rankings_count(spark):
    ranks = evaluate.known_item_ranks(
        ranking(spark, [(5, 7, 7)]), relevance(spark, [7, 8])
    )
    assert [r["rank"] for r in ranks.orderBy("query_id").collect()] == [2, 0]


def test_cutoff_wider_than_ranking(spark):
    ranks = evaluate.known_item_ranks(ranking(spark, RANKED), relevance(spark, WANTED))
    found = evaluate.known_item_metrics(ranks, recall_ks=(100,), metric_cutoff=2).first()
    assert found.recall_at_100 == 0.75
    assert found.mrr_at_2 == pytest.approx(1.5 / 4)
    for bad in ({"recall_ks": ()}, {"recall_ks": (0,)}, {"metric_cutoff": 0}):
        with pytest.raises(ValueError):
            evaluate.known_item_metrics(ranks, **bad)


def test_overlap(spark):
    a = ranking(spark, [(1, 2, 3), (4, 5, 6)])
    b = ranking(spark, [(1, 3, 8), (4, 9, 10)])
    found = evaluate.ranking_overlap(a, b, 3).first()
    assert (found.queries, found.overlap_at_3, found.complete) == (2, 0.5, True)
    short = evaluate.ranking_overlap(a, ranking(spark, [(1, 2, 3)]), 3).first()
    assert (short.queries, short.overlap_at_3, short.complete) == (2, 0.5, False)
    apart = evaluate.ranking_overlap(a, ranking(spark, [(7, 8, 9), (1, 2, 3)]), 3).first()
    assert apart.overlap_at_3 == 0.0
    with pytest.raises(ValueError):
        evaluate.ranking_overlap(a, b, 0)


def test_stage_latency(spark):
    rows = spark.createDataFrame([(1.0, 10.0), (3.0, 20.0)], "search_ms double, total_ms double")
    found = {r.stage: r for r in evaluate.stage_latency(rows, ["search_ms", "total_ms"]).collect()}
    assert (found["search_ms"].p50, found["total_ms"].p95) == (2.0, 19.5)
    assert found["total_ms"].mean == 15.0


def test_every_vector_is_its_own_nearest(spark):
    vectors = unit([[1, 0], [0, 1], [1, 1]])
    hits = exact_topk(table(spark, vectors, "query_id"), table(spark, vectors), 3, 2)
    ranks = evaluate.known_item_ranks(hits, relevance(spark, [0, 1, 2]))
    assert evaluate.known_item_metrics(ranks).first().recall_at_1 == 1.0


def test_compare_reports_each_step(spark):
    rng = np.random.default_rng(3)
    vectors = unit(rng.normal(size=(60, 8)))
    queries = table(spark, vectors, "query_id")
    found = {
        r.system: r
        for r in compare_retrievers(
            queries, table(spark, vectors), relevance(spark, range(60)), 8, folding(8, 4), 5, (1, 5)
        ).collect()
    }
    assert set(found) == {"exact_full", "exact_reduced", "cells_probe_1", "cells_probe_5"}
    assert found["exact_full"].overlap_at_10 is None
    assert found["exact_full"].recall_at_1 == 1.0
    # All cells give the exact ranking back.
    assert found["cells_probe_5"].overlap_at_10 == 1.0
    assert found["cells_probe_1"].overlap_at_10 < 1.0
    assert found["exact_full"].queries == 60


def labelled(spark, labels, scores):
    return spark.createDataFrame(list(zip(labels, scores)), "label int, score double")


def brute_threshold(labels, scores):
    best = None
    for t in sorted({s for s in scores if not math.isnan(s)}):
        hit = [s >= t for s in scores]
        tp = sum(h and y for h, y in zip(hit, labels))
        fp = sum(h and not y for h, y in zip(hit, labels))
        fn = sum(not h and y for h, y in zip(hit, labels))
        p = tp / (tp + fp) if tp + fp else 0.0
        r = tp / (tp + fn) if tp + fn else 0.0
        f1 = 2 * p * r / (p + r) if p + r else 0.0
        accuracy = sum(h == bool(y) for h, y in zip(hit, labels)) / len(labels)
        if best is None or (f1, accuracy, -t) > best[:3]:
            best = (f1, accuracy, -t)
    return best


def test_calibration_example(spark):
    rows = labelled(spark, [1, 1, 1, 0, 0], [8.0, 5.0, 2.0, -4.0, -8.0])
    best = calibrate.best_threshold(rows, "label", "score").first()
    assert (best.threshold, best.f1, best.accuracy) == (2.0, 1.0, 1.0)


@pytest.mark.parametrize(
    "labels, scores",
    [
        ([1, 1, 1], [1.0, 2.0, 3.0]),
        ([0, 0, 0], [1.0, 2.0, 3.0]),
        ([1, 0, 1, 0, 1, 0], [2.0, 2.0, 2.0, 1.0, 1.0, 3.0]),
        ([1, 0, 1], [float("nan"), 1.0, 2.0]),
        (np.random.default_rng(1).integers(0, 2, 300).tolist(),
         np.round(np.random.default_rng(2).normal(size=300), 1).tolist()),
    ],
)
def test_calibration_equals_brute_force(spark, labels, scores):
    best = calibrate.best_threshold(labelled(spark, labels, scores), "label", "score").first()
    assert (best.f1, best.accuracy, -best.threshold) == pytest.approx(
        brute_threshold(labels, scores)
    )


def test_threshold_metrics(spark):
    rows = labelled(spark, [1, 0, 1, 0], [3.0, 2.0, float("nan"), 0.0])
    found = calibrate.threshold_metrics(rows, "label", "score", 2.0).first()
    assert (found.tp, found.fp, found.fn, found.tn) == (1, 1, 1, 1)
    none = calibrate.threshold_metrics(rows, "label", "score", 9.0).first()
    assert (none.precision, none.recall, none.f1) == (0.0, 0.0, 0.0)
    with pytest.raises(Exception, match="zero or one"):
        bad = labelled(spark, [2], [1.0])
        calibrate.threshold_metrics(bad, "label", "score", 1.0).collect()


def test_hot_query_in_metrics(spark):
    """One system holds most of the rankings; groups stay separate."""
    rows = [("big", q, 1, q) for q in range(300)] + [("small", 0, 2, 0), ("small", 0, 1, 9)]
    hits = spark.createDataFrame(rows, "system string, query_id bigint, rank int, doc_id bigint")
    expected = hits.filter("system = 'big'").select(
        "system", "query_id", F.col("doc_id").alias("relevant_doc_id")
    ).union(spark.createDataFrame([("small", 0, 0)], "s string, q bigint, r bigint"))
    ranks = evaluate.known_item_ranks(hits, expected, by=("system",))
    found = {r.system: r for r in evaluate.known_item_metrics(ranks, by=("system",)).collect()}
    assert (found["big"].recall_at_1, found["small"].recall_at_1) == (1.0, 0.0)
    assert found["small"].mrr_at_10 == 0.5
