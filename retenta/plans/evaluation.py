"""Evaluation job: metrics, ROC curve and attributions of the test set."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from retenta.operators import churn_model, evaluate
from retenta.operators.attribution import feature_attribution
from retenta.plans.training import CHURN_MODEL, part, split_matrix
from retenta.session import staged
from retenta.sources import artifacts


def run_evaluation(
    spark: SparkSession, matrix: DataFrame, models_dir: str, runs_dir: str
) -> dict[str, Any]:
    """Score the test part of ``matrix`` with the saved model and write what was found.

    All test rows are explained. The matrix is written first, as the split reads it twice.
    """
    path = f"{models_dir}/{CHURN_MODEL}"
    model = churn_model.load_churn_model(spark, path)
    with (
        staged(matrix, "matrix") as written,
        staged(part(split_matrix(written), "test"), "test") as test,
        staged(churn_model.score(model, test), "scored") as scored,
    ):
        metrics = evaluate.churn_metrics(scored, "churn_proba", "prediction", "churned")
        artifacts.save_metrics(spark, metrics, "churn_evaluation", runs_dir)
        curve = evaluate.roc_curve(scored, "churn_proba", "churned")
        artifacts.write_roc_curve(curve, metrics["roc_auc"], f"{runs_dir}/roc_curve")
        feature_attribution(model, test).write.mode("overwrite").parquet(f"{runs_dir}/attribution")
    return metrics
