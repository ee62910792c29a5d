"""Evaluation of a churn score against labels."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retenta.functions.scalars import mean
from retenta.operators.ranking import running_totals


def _score_counts(scored: DataFrame, score: str, label: str) -> DataFrame:
    """One row per distinct score with its positives and negatives.

    Spark would rank NaN above all numbers, so a NaN score stops the job.
    """
    value = F.col(score).cast("double")
    checked = F.when(F.isnan(value), F.raise_error(F.lit(f"NaN in {score}")).cast("double")).otherwise(value)
    return (
        scored.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(checked.alias("score"))
        .agg(
            F.count(F.when(F.col(label) == 1, 1)).alias("pos"),
            F.count(F.when(F.col(label) != 1, 1)).alias("neg"),
        )
    )


def _ranked(counts: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Counts with positives and negatives at or above the score, over all, and of the next lower score."""
    rising = running_totals(counts, keys, score, ["pos", "neg"], ["pos", "neg"])
    above = {f"{name}_upto": F.col(f"{name}_all") - F.col(f"{name}_upto") + F.col(name) for name in ("pos", "neg")}
    return rising.withColumns(above)


def _ranked_scores(scored: DataFrame, score: str, label: str) -> DataFrame:
    return _ranked(_score_counts(scored, score, label), [], "score")


def roc_auc_of_counts(counts: DataFrame, keys: list[str], score: str) -> DataFrame:
    """``keys`` and ``roc_auc`` from one row per key and distinct score, with its numbers of ``pos`` and ``neg``.

    The area is twice summed in whole numbers, so no rounding depends on the task order.
    """
    wide = "decimal(38,0)"
    strip = F.col("neg").cast("decimal(18,0)") * (2 * F.col("pos_upto") - F.col("pos")).cast("decimal(19,0)")
    area = _ranked(counts, keys, score).groupBy(*keys).agg(
        F.sum(strip).cast(wide).alias("twice"),
        F.max("pos_all").alias("pos_all"),
        F.max("neg_all").alias("neg_all"),
    )
    whole = 2.0 * F.col("pos_all").cast("double") * F.col("neg_all").cast("double")
    return area.select(*keys, F.try_divide(F.col("twice").cast("double"), whole).alias("roc_auc"))


def roc_auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve; equal scores count half. Null where a class is missing."""
    return roc_auc_of_counts(_score_counts(scored, score, label), [], "score")


def average_precision(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Sum of precision times the step in recall; no interpolation."""
    ranked = _ranked_scores(scored, score, label)
    at_or_above = (F.col("pos_upto") + F.col("neg_upto")).cast("double")
    precision = F.try_divide(F.col("pos_upto").cast("double"), at_or_above)
    total = ranked.agg(F.sum(F.col("pos") * precision).alias("total"), F.max("pos_all").alias("pos_all"))
    return total.select(mean("total", "pos_all").alias("average_precision"))


def roc_curve(scored: DataFrame, score: str, label: str, drop_collinear: bool = True) -> DataFrame:
    """``threshold``, ``fpr``, ``tpr``, from (0, 0) at an infinite threshold to (1, 1).

    ``drop_collinear`` leaves out points on the straight line between their neighbours:
    those after which the curve goes on with the same numbers of positives and negatives.
    The highest score and the lowest stay.
    """
    ranked = _ranked_scores(scored, score, label)
    if drop_collinear:
        ranked = ranked.filter(
            (F.col("pos_upto") + F.col("neg_upto") == F.col("pos") + F.col("neg"))
            | F.col("pos_previous").isNull()
            | (F.col("pos_previous") != F.col("pos"))
            | (F.col("neg_previous") != F.col("neg"))
        )
    points = ranked.select(
        F.col("score").alias("threshold"),
        mean("neg_upto", "neg_all").alias("fpr"),
        mean("pos_upto", "pos_all").alias("tpr"),
    )
    origin = scored.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return origin.unionByName(points).orderBy(F.desc("threshold"))


def classification_report(predicted: DataFrame, prediction: str, label: str) -> DataFrame:
    """Rows for class 0, class 1, accuracy, macro avg and weighted avg.

    A ratio with nothing in its denominator is 0. The accuracy row repeats accuracy in
    all three measures.
    """

    def cell(truth: int, guess: int):
        hit = (F.col(label).cast("int") == truth) & (F.col(prediction).cast("int") == guess)
        return F.count(F.when(hit, 1)).cast("double")

    cells = predicted.agg(
        cell(0, 0).alias("n00"), cell(0, 1).alias("n01"), cell(1, 0).alias("n10"), cell(1, 1).alias("n11")
    )

    def ratio(numerator, denominator):
        return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))

    n00, n01, n10, n11 = (F.col(name) for name in ("n00", "n01", "n10", "n11"))
    measures = cells.select(
        ratio(n00, n00 + n10).alias("p0"),
        ratio(n11, n11 + n01).alias("p1"),
        ratio(n00, n00 + n01).alias("r0"),
        ratio(n11, n11 + n10).alias("r1"),
        ratio(2.0 * n00, 2.0 * n00 + n01 + n10).alias("f0"),
        ratio(2.0 * n11, 2.0 * n11 + n01 + n10).alias("f1"),
        (n00 + n01).alias("s0"),
        (n10 + n11).alias("s1"),
        ratio(n00 + n11, n00 + n01 + n10 + n11).alias("accuracy"),
    )
    s0, s1 = F.col("s0"), F.col("s1")

    def macro(a: str, b: str):
        return (F.col(a) + F.col(b)) / 2.0

    def weighted(a: str, b: str):
        return ratio(F.col(a) * s0 + F.col(b) * s1, s0 + s1)

    def row(name: str, precision, recall, f1, support):
        return F.struct(
            F.lit(name).alias("class"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1_score"),
            support.cast("bigint").alias("support"),
        )

    accuracy = F.col("accuracy")
    return measures.select(
        F.inline(
            F.array(
                row("0", F.col("p0"), F.col("r0"), F.col("f0"), s0),
                row("1", F.col("p1"), F.col("r1"), F.col("f1"), s1),
                row("accuracy", accuracy, accuracy, accuracy, s0 + s1),
                row("macro avg", macro("p0", "p1"), macro("r0", "r1"), macro("f0", "f1"), s0 + s1),
                row(
                    "weighted avg",
                    weighted("p0", "p1"),
                    weighted("r0", "r1"),
                    weighted("f0", "f1"),
                    s0 + s1,
                ),
            )
        )
    )


def churn_metrics(scored: DataFrame, score: str, prediction: str, label: str) -> dict[str, Any]:
    """ROC-AUC, average precision and the report of a scored set, as one small dict."""
    rows = classification_report(scored, prediction, label).collect()
    return {
        "roc_auc": roc_auc(scored, score, label).first()["roc_auc"],
        "average_precision": average_precision(scored, score, label).first()["average_precision"],
        "classification_report": {
            row["class"]: {k: v for k, v in row.asDict().items() if k != "class"} for row in rows
        },
    }
