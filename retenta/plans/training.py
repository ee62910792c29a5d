"""Training job: value models, labels, split, classifier, test score."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retenta.config import CHURN_CUTOFF_DATE, CHURN_WINDOW_DAYS, FEATURE_COLS, RANDOM_SEED, TRAIN_RATIO, VAL_RATIO
from retenta.operators import churn_model, evaluate, features
from retenta.operators.clv_fit import fit_bgnbd, fit_gamma_gamma
from retenta.operators.ranking import stratified_split
from retenta.session import staged
from retenta.sources import artifacts
from retenta.sources.retail import RawTables

CHURN_MODEL = "churn_model"


def feature_matrix(spark: SparkSession, tables: RawTables, models_dir: str) -> DataFrame:
    """Features labelled by the saved BG/NBD parameters; an error if there are none."""
    params = artifacts.load_bgnbd_params(spark, models_dir)
    behavioral = features.behavioral_features(
        tables.orders, tables.customers, tables.order_payments, tables.order_items, tables.order_reviews, tables.products
    )
    return features.feature_matrix(behavioral, params)


def window_matrix(tables: RawTables, cutoff_date: str, churn_window_days: int) -> DataFrame:
    """Features labelled by the outcome window, for data whose buyers come back often."""
    dataset = features.churn_dataset(
        tables.orders,
        tables.customers,
        tables.order_payments,
        tables.order_items,
        tables.order_reviews,
        tables.products,
        cutoff_date,
        churn_window_days,
    )
    return matrix_columns(dataset)


def matrix_columns(dataset: DataFrame) -> DataFrame:
    return dataset.select("customer_unique_id", *FEATURE_COLS, "churned")


def split_matrix(matrix: DataFrame) -> DataFrame:
    return stratified_split(matrix, "customer_unique_id", "churned", TRAIN_RATIO, VAL_RATIO, RANDOM_SEED)


def part(split: DataFrame, name: str) -> DataFrame:
    return split.filter(F.col("split") == name).drop("split")


def train(
    spark: SparkSession,
    tables: RawTables,
    models_dir: str,
    runs_dir: str,
    labels: str = "alive",
    n_trees: int = churn_model.N_TREES,
    cutoff_date: str = CHURN_CUTOFF_DATE,
    churn_window_days: int = CHURN_WINDOW_DAYS,
) -> dict[str, Any]:
    """Fit and save all models; returns the validation and test ROC-AUC.

    The value models come first, as ``labels='alive'`` needs their parameters.
    ``labels='window'`` takes the labels from the outcome window. What later
    work reads more than once is written to the shared folder for the while.
    """
    rfm_features = features.rfm_features(tables.orders, tables.customers, tables.order_payments)
    with staged(rfm_features, "rfm") as rfm:
        bgnbd, gamma_gamma = fit_bgnbd(rfm), fit_gamma_gamma(rfm)
    artifacts.save_clv_params(spark, bgnbd, gamma_gamma, models_dir)
    if labels == "alive":
        unsplit = feature_matrix(spark, tables, models_dir)
    else:
        unsplit = window_matrix(tables, cutoff_date, churn_window_days)
    scores = {}
    with staged(unsplit, "matrix") as matrix, staged(split_matrix(matrix), "split") as split:
        model = churn_model.train_churn_model(part(split, "train"), n_trees=n_trees)
        churn_model.save_churn_model(spark, model, f"{models_dir}/{CHURN_MODEL}")
        for name in ("val", "test"):
            scored = churn_model.score(model, part(split, name))
            scores[f"{name}_roc_auc"] = evaluate.roc_auc(scored, "churn_proba", "churned").first()["roc_auc"]
    artifacts.save_metrics(spark, {"test_roc_auc": scores["test_roc_auc"]}, "churn_gbt", runs_dir)
    return scores
