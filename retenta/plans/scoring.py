"""Batch scoring job: churn probability, risk tier and lifetime value per person."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from retenta.operators import churn_model, clv_predict, features
from retenta.plans.training import CHURN_MODEL
from retenta.sources import artifacts
from retenta.sources.retail import RawTables


def batch_predictions(spark: SparkSession, tables: RawTables, models_dir: str) -> DataFrame:
    """One lazy plan over saved models; persons present in both feature sets."""
    model = churn_model.load_churn_model(spark, f"{models_dir}/{CHURN_MODEL}")
    bgnbd, gamma_gamma = artifacts.load_clv_params(spark, models_dir)
    behavioral = features.behavioral_features(
        tables.orders, tables.customers, tables.order_payments, tables.order_items, tables.order_reviews, tables.products
    )
    rfm = features.rfm_features(tables.orders, tables.customers, tables.order_payments)
    churn = churn_model.predict_churn(model, behavioral)
    value = clv_predict.predict_clv(rfm, bgnbd, gamma_gamma)
    return churn.join(value, "customer_unique_id")


def run_batch_predictions(
    spark: SparkSession, tables: RawTables, models_dir: str, output_path: str | None = None
) -> DataFrame:
    """As above; with a path the predictions are written as CSV and read from there."""
    predictions = batch_predictions(spark, tables, models_dir)
    if output_path is None:
        return predictions
    artifacts.write_predictions(predictions, output_path)
    return artifacts.read_predictions(spark, output_path)
