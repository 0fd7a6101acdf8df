"""Answerability threshold: metrics at one threshold, best over all scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citespark.operators.running import running_totals
from citespark.operators.stable import cut_lineage


def _labelled(df: DataFrame, label: str, score: str) -> DataFrame:
    """Checked labels; a score that is NaN or missing never counts as positive."""
    value = F.col(score).cast("double")
    known = F.coalesce(F.col(label).isin(0, 1), F.lit(False))
    return df.select(
        F.when(known, F.col(label).cast("int"))
        .otherwise(F.raise_error(F.lit("labels must be zero or one")))
        .alias("_label"),
        F.when(~F.isnan(value), value).alias("_score"),
    )


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / whole).otherwise(F.lit(0.0))


def _rates(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    precision = _share(tp, tp + fp)
    recall = _share(tp, tp + fn)
    f1 = _share(2 * precision * recall, precision + recall)
    return [
        _share(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        f1.alias("f1"),
    ]


def threshold_metrics(df: DataFrame, label: str, score: str, threshold: float) -> DataFrame:
    """Accuracy, precision, recall and F1 when scores from the threshold up count."""
    positive = F.coalesce(F.col("_score") >= F.lit(float(threshold)), F.lit(False))
    actual = F.col("_label") == 1
    counts = _labelled(df, label, score).agg(
        F.count_if(positive & actual).alias("tp"),
        F.count_if(positive & ~actual).alias("fp"),
        F.count_if(~positive & actual).alias("fn"),
        F.count_if(~positive & ~actual).alias("tn"),
    )
    cells = [F.col(c) for c in ("tp", "fp", "fn", "tn")]
    return counts.select(F.lit(float(threshold)).alias("threshold"), *cells, *_rates(*cells))


def thresholds(df: DataFrame, label: str, score: str) -> DataFrame:
    """Metrics at every distinct score, from running counts over grouped scores."""
    # Written once; rows without a score keep a group of their own for the totals.
    per_score = cut_lineage(
        _labelled(df, label, score)
        .groupBy("_score")
        .agg(
            F.count_if(F.col("_label") == 1).alias("_pos"),
            F.count_if(F.col("_label") == 0).alias("_neg"),
        )
    )
    scored = per_score.filter(F.col("_score").isNotNull())
    running = running_totals(scored, "_score", ["_pos", "_neg"], [], descending=True)
    all_pos = per_score.agg(F.sum("_pos")).scalar()
    all_neg = per_score.agg(F.sum("_neg")).scalar()
    tp, fp = F.col("cum__pos"), F.col("cum__neg")
    return running.select(
        F.col("_score").alias("threshold"), *_rates(tp, fp, all_pos - tp, all_neg - fp)
    )


def best_threshold(df: DataFrame, label: str, score: str) -> DataFrame:
    """The threshold with the best F1, then accuracy, then the lowest value.

    A table without a labelled score has none; that is an error.
    """
    if _labelled(df, label, score).filter(F.col("_score").isNotNull()).isEmpty():
        raise ValueError("there is no labelled score to calibrate on")
    row = F.struct("threshold", "accuracy", "precision", "recall", "f1")
    order = F.struct("f1", "accuracy", -F.col("threshold"))
    return (
        thresholds(df, label, score)
        .agg(F.max_by(row, order).alias("best"))
        .filter(F.col("best").isNotNull())
        .select("best.*")
    )
