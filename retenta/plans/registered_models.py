"""Registered queries that fit or apply a model."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retenta.config import FEATURE_COLS
from retenta.operators import attribution, churn_model, evaluate, features
from retenta.operators.clv_fit import Certificate, certified_bgnbd, certified_gamma_gamma, fit_bgnbd, fit_gamma_gamma
from retenta.plans import evaluation, scoring, training
from retenta.session import new_shared_path, stage, staged
from retenta.sources import artifacts
from retenta.sources.retail import raw_tables

CUTOFF, WINDOW_DAYS = "1999-01-01", 365
# Where nobody leaves for good, a and b run towards zero and the objective hardly bends along them.
BGNBD_DIGITS = {"r": 3, "alpha": 2, "a": 2, "b": 2, "objective": 5, "gradient_norm": 4, "least_pivot": 3}
GAMMA_GAMMA_DIGITS = {"p": 4, "q": 4, "v": 4, "objective": 6, "gradient_norm": 4, "least_pivot": 4}


def _rfm(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = raw_tables(spark, sf_dir, delivery_dates=False)
    return features.rfm_features(r.orders, r.customers, r.order_payments)


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training.window_matrix(raw_tables(spark, sf_dir), CUTOFF, WINDOW_DAYS)


def _train(spark: SparkSession, sf_dir: str) -> tuple[str, dict]:
    models_dir, runs_dir = new_shared_path(spark, "models"), new_shared_path(spark, "runs")
    scores = training.train(
        spark,
        raw_tables(spark, sf_dir),
        models_dir,
        runs_dir,
        "window",
        cutoff_date=CUTOFF,
        churn_window_days=WINDOW_DAYS,
    )
    return models_dir, scores


def _trained(spark: SparkSession, matrix: DataFrame):
    """A classifier trained on a written matrix, saved and loaded again, and its folder."""
    path = f"{new_shared_path(spark, 'models')}/{training.CHURN_MODEL}"
    with staged(training.split_matrix(matrix), "split") as split:
        churn_model.save_churn_model(spark, churn_model.train_churn_model(training.part(split, "train")), path)
    return churn_model.load_churn_model(spark, path), path


def _classifier(spark: SparkSession, sf_dir: str):
    """A classifier trained for this query, saved and loaded again, and its folder."""
    with staged(_matrix(spark, sf_dir), "matrix") as matrix:
        return _trained(spark, matrix)


def _classifier_and_behavior(spark: SparkSession, sf_dir: str):
    """A classifier as by :func:`_classifier`, and the behaviour features of every person.

    The totals behind both are made in one pass over the raw tables and written: one row per person.
    """
    r = raw_tables(spark, sf_dir)
    totals = features.history_totals(
        r.orders, r.customers, r.order_payments, r.order_items, r.order_reviews, r.products, CUTOFF, WINDOW_DAYS
    )
    totals = stage(totals, "totals")
    with staged(training.matrix_columns(features.churn_dataset_of_totals(totals, CUTOFF)), "matrix") as matrix:
        model, _ = _trained(spark, matrix)
    return model, features.behavior_of_totals(totals)


def _certified(spark: SparkSession, params: tuple, certificate: Certificate, digits: dict[str, int]) -> DataFrame:
    """Parameters and certificate in one row, to the digits that a second way of finding them gives too."""
    found = params._asdict() | certificate._asdict()
    schema = ", ".join(f"{name} {'bigint' if name == 'n_customers' else 'double'}" for name in found)
    row = spark.createDataFrame([tuple(found.values())], schema)
    return row.withColumns({name: F.round(name, places) for name, places in digits.items()})


def bgnbd_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _certified(spark, *certified_bgnbd(_rfm(spark, sf_dir)), BGNBD_DIGITS)


def gamma_gamma_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _certified(spark, *certified_gamma_gamma(_rfm(spark, sf_dir)), GAMMA_GAMMA_DIGITS)


def clv_params_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters fitted, saved and loaded again; an error unless they are the same."""
    folder = new_shared_path(spark, "models")
    with staged(_rfm(spark, sf_dir), "rfm") as rfm:
        fitted = fit_bgnbd(rfm), fit_gamma_gamma(rfm)
    artifacts.save_clv_params(spark, *fitted, folder)
    bgnbd, gamma_gamma = artifacts.load_clv_params(spark, folder)
    if (bgnbd, gamma_gamma) != fitted:
        raise AssertionError(f"saved {fitted}, loaded {(bgnbd, gamma_gamma)}")
    values = bgnbd._asdict() | gamma_gamma._asdict()
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{name} double" for name in values))
    return row.select(*[F.round(name, (BGNBD_DIGITS | GAMMA_GAMMA_DIGITS)[name]).alias(name) for name in values])


def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features, gaps filled with the median of the training part, scaled by its mean and deviation."""
    split = stage(training.split_matrix(stage(_matrix(spark, sf_dir), "matrix")), "split")
    rows = churn_model.with_double_features(split)
    scaler = Pipeline(stages=churn_model.fill_and_scale()).fit(rows.filter(F.col("split") == "train"))
    scaled = scaler.transform(rows).withColumn("scaled", vector_to_array("features"))
    return scaled.select(
        "customer_unique_id",
        "split",
        *[F.round(F.col("scaled")[i], 7).alias(name) for i, name in enumerate(FEATURE_COLS)],
    )


def train_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation ROC-AUC after each tree of a classifier fitted on the training part."""
    with staged(_matrix(spark, sf_dir), "matrix") as matrix:
        split = stage(training.split_matrix(matrix), "split")
    model = churn_model.train_churn_model(training.part(split, "train"))
    return churn_model.validation_report(model, training.part(split, "val"))


def predict_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every customer with behaviour features."""
    return churn_model.predict_churn(*_classifier_and_behavior(spark, sf_dir))


def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return churn_model.feature_importance(spark, _classifier(spark, sf_dir)[0])


def feature_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributions of every person, with the gap between their sum and the log-odds."""
    explained = attribution.feature_attribution(*_classifier_and_behavior(spark, sf_dir))
    parts = [F.col(name) for name in explained.columns if name.startswith("phi_")]
    total = reduce(lambda a, b: a + b, parts, F.col("base_value"))
    return explained.withColumn("gap", F.round(F.abs(total - F.col("log_odds")), 9))


def batch_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.run_batch_predictions(
        spark, raw_tables(spark, sf_dir), _train(spark, sf_dir)[0], new_shared_path(spark, "predictions")
    )


def train_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, scores = _train(spark, sf_dir)
    return spark.createDataFrame([tuple(scores.values())], ", ".join(f"{name} double" for name in scores))


def churn_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs_dir = new_shared_path(spark, "runs")
    # One matrix serves the training and the evaluation.
    with staged(_matrix(spark, sf_dir), "matrix") as matrix:
        _, path = _trained(spark, matrix)
        evaluation.run_evaluation(spark, matrix, path.rpartition("/")[0], runs_dir)
    return artifacts.load_metrics(spark, runs_dir).drop("timestamp")
