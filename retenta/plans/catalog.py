"""Every query by name: what to run on a folder of the retail star schema."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retenta.config import FEATURE_COLS, RANDOM_SEED, TRAIN_RATIO, VAL_RATIO
from retenta.functions.clv import BGNBDParams, GammaGammaParams
from retenta.functions.scalars import feature_label, risk_tier
from retenta.operators import churn_model, clv_predict, evaluate, features, marts, orders, profile, quality, report
from retenta.operators.ranking import seeded_sample, stratified_split
from retenta.plans import models
from retenta.plans import registered_models as fitted
from retenta.session import new_shared_path, stage
from retenta.sources import artifacts, warehouse
from retenta.sources.retail import raw_tables

Query = Callable[[SparkSession, str], DataFrame]

# The data ends in 2001, so the cutoff lies inside it.
CUTOFF, WINDOW_DAYS = "1999-01-01", 365
# Parameters for the queries that score without a fit.
BGNBD = BGNBDParams(r=0.9, alpha=60.0, a=0.7, b=2.5)
GAMMA_GAMMA = GammaGammaParams(p=2.0, q=3.5, v=400000.0)
HORIZON_WEEKS = 26.0


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, digits) for name in names})


def _rfm(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = raw_tables(spark, sf_dir, delivery_dates=False)
    return features.rfm_features(r.orders, r.customers, r.order_payments)


def _behavioral(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = raw_tables(spark, sf_dir)
    return features.behavioral_features(
        r.orders, r.customers, r.order_payments, r.order_items, r.order_reviews, r.products
    )


def _churn_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = raw_tables(spark, sf_dir)
    return features.churn_dataset(
        r.orders,
        r.customers,
        r.order_payments,
        r.order_items,
        r.order_reviews,
        r.products,
        CUTOFF,
        WINDOW_DAYS,
    )


def _staged(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return models.staging_models(raw_tables(spark, sf_dir))


def _staging_query(name: str) -> Query:
    return lambda spark, sf_dir: _staged(spark, sf_dir)[name]


def _customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.customer_orders(_staged(spark, sf_dir))


def _rfm_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.mart_rfm_features(_customer_orders(spark, sf_dir))


def _built(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return models.build_models(
        spark, raw_tables(spark, sf_dir), database=_new_database(spark), location=new_shared_path(spark, "marts")
    )


def build_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of the marts, read from the tables just written."""
    built = _built(spark, sf_dir)
    return warehouse.row_counts({name: built[name] for name in built if name.startswith("mart_")})


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions with a simple score and value, for the reports on predictions."""
    rfm = _rfm(spark, sf_dir)
    share_idle = F.col("recency_days") / (F.col("customer_age_days") + 1.0)
    value = F.when(F.col("customer_unique_id") % 5 == 0, 0.0).otherwise(F.col("monetary_value") / 1000.0)
    scored = rfm.select(
        "customer_unique_id", share_idle.alias("churn_proba"), value.alias("predicted_clv")
    )
    return scored.select("customer_unique_id", "churn_proba", risk_tier("churn_proba").alias("churn_risk_tier"), "predicted_clv")


def scored_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label by inactivity, a score with ties, and a prediction from the score."""
    labelled = features.add_churn_label(_rfm(spark, sf_dir), 180)
    score = 1.0 / (F.col("frequency") + 1.0) + F.col("customer_unique_id") % 7 / 100.0
    scored = labelled.select("customer_unique_id", "churned", score.alias("score"))
    return scored.withColumn("prediction", (F.col("score") > 0.2).cast("int"))


def _on_predictions(report_of: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: report_of(predictions(spark, sf_dir))


def _on_scores(report_of: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: report_of(scored_customers(spark, sf_dir))


def _purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = raw_tables(spark, sf_dir, delivery_dates=False)
    return report.purchases_per_customer(r.orders, r.customers)


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.feature_matrix(_behavioral(spark, sf_dir), BGNBD)


# --- sources and sinks ----------------------------------------------------------------


def ingest_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export all raw tables as CSV and load them into catalog tables, with one name that has no file."""
    tables = raw_tables(spark, sf_dir).as_dict()
    folder = new_shared_path(spark, "csv")
    files = {name: f"{folder}/{name}" for name in [*tables, "sessions"]}
    for name, table in tables.items():
        table.write.option("header", True).option("escape", '"').csv(files[name])
    return warehouse.create_warehouse(
        spark, files, database=_new_database(spark), location=new_shared_path(spark, "warehouse")
    )


def _new_database(spark: SparkSession) -> str:
    """A database of its own for each run, so that runs don't overwrite each other's tables."""
    name = f"retenta_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name}")
    return name


def load_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payments, saved as a catalog table and loaded by its name."""
    database, path = _new_database(spark), new_shared_path(spark, "tables")
    payments = raw_tables(spark, sf_dir).order_payments
    payments.write.option("path", path).saveAsTable(f"{database}.raw_order_payments")
    return warehouse.load_table(spark, "raw_order_payments", database)


def table_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = raw_tables(spark, sf_dir, delivery_dates=False).as_dict()
    listed = ["orders", "customers", "order_payments", "order_reviews", "order_items"]
    return warehouse.row_counts({f"raw_{name}": tables[name] for name in listed})


def predictions_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_shared_path(spark, "predictions")
    artifacts.write_predictions(predictions(spark, sf_dir), path)
    return artifacts.read_predictions(spark, path)


def metrics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_shared_path(spark, "runs")
    kpis = report.kpi_cards(predictions(spark, sf_dir)).first().asDict()
    artifacts.save_metrics(spark, kpis, "kpi_run", folder)
    return rounded(artifacts.load_metrics(spark, folder), 9, "avg_churn_proba").drop("timestamp")


# --- data quality ---------------------------------------------------------------------


def _quality(kind: Callable) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = {f"raw_{name}": table for name, table in raw_tables(spark, sf_dir).as_dict().items()}
        checks = quality.RAW_CHECKS | quality.STAGING_CHECKS | quality.MART_CHECKS
        return kind(raw | _built(spark, sf_dir), checks)

    return run


# --- features, marts, labels ----------------------------------------------------------


def order_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders.order_enriched(*models.per_order_inputs(_staged(spark, sf_dir)))


def active_after_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = raw_tables(spark, sf_dir, delivery_dates=False)
    return features.active_after_cutoff(r.orders, r.customers, r.order_payments, r.order_items, CUTOFF, WINDOW_DAYS)


def snapshot_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = raw_tables(spark, sf_dir, delivery_dates=False)
    return features.snapshot_date(r.orders, r.customers, r.order_payments)


def churn_label_palive(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = features.add_alive_label(_rfm(spark, sf_dir), BGNBD)
    return rounded(labelled.select("customer_unique_id", "p_alive", "churned"), 9, "p_alive")


def describe_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and label."""
    labelled = features.add_churn_label(_behavioral(spark, sf_dir), 180)
    summary = profile.describe(labelled, [*FEATURE_COLS, "churned"])
    return rounded(summary, 4, "mean", "std", "p25", "p50", "p75")


def describe_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = profile.describe(_purchases(spark, sf_dir), ["n_purchases"])
    return rounded(summary, 4, "mean", "std", "p25", "p50", "p75")


def feature_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = features.add_churn_label(_behavioral(spark, sf_dir), 180)
    return rounded(profile.correlations(labelled, [*FEATURE_COLS, "churned"]), 7, "correlation")


def merge_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of delivered, paid customers joined with value estimates of the same."""
    churn = predictions(spark, sf_dir).drop("predicted_clv")
    value = clv_predict.predict_clv(_rfm(spark, sf_dir), BGNBD, GAMMA_GAMMA)
    return rounded(churn.join(value, "customer_unique_id"), 2, "predicted_clv")


def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    dataset = stage(_churn_dataset(spark, sf_dir).select("customer_unique_id", "churned"), "dataset")
    split = stratified_split(dataset, "customer_unique_id", "churned", TRAIN_RATIO, VAL_RATIO, RANDOM_SEED)
    return split.groupBy("churned", "split").agg(F.count("*").alias("n"))


def feature_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display names of the profiled columns; one of them has no name of its own."""
    counted = profile.melt(_behavioral(spark, sf_dir), [*FEATURE_COLS, "frequency"]).groupBy("feature").agg(
        F.count("value").alias("n")
    )
    return counted.select("feature", feature_label("feature").alias("label"), "n")


def queries() -> dict[str, Query]:
    return {
        # sources and sinks
        "ingest_csv": ingest_csv,
        "load_table": load_table,
        "table_row_counts": table_row_counts,
        "predictions_csv_roundtrip": predictions_csv_roundtrip,
        "metrics_json": metrics_json,
        # staging
        **{name: _staging_query(name) for name in quality.STAGING_CHECKS},
        "build_models": build_models,
        # data quality
        "dq_not_null": _quality(quality.not_null_report),
        "dq_unique": _quality(quality.unique_report),
        # features
        "rfm_features": _rfm,
        "behavioral_features": _behavioral,
        "churn_dataset": _churn_dataset,
        "churn_rate": lambda s, d: features.churn_rate(_churn_dataset(s, d)),
        "active_after_cutoff": active_after_cutoff,
        "snapshot_date": snapshot_date,
        "order_revenue": lambda s, d: orders.order_revenue(_staged(s, d)["stg_order_payments"]),
        "order_reviews": lambda s, d: orders.order_reviews(_staged(s, d)["stg_order_reviews"]),
        "order_enriched": order_enriched,
        "int_customer_orders": _customer_orders,
        "mart_rfm_features": _rfm_mart,
        "mart_clv_features": lambda s, d: marts.mart_clv_features(_rfm_mart(s, d)),
        "mart_churn_labels": lambda s, d: marts.mart_churn_labels(_rfm_mart(s, d)),
        "churn_label_window": lambda s, d: features.add_churn_label(_rfm(s, d), WINDOW_DAYS),
        "churn_label_palive": churn_label_palive,
        "describe_features": describe_features,
        "describe_purchases": describe_purchases,
        "feature_correlation": feature_correlation,
        "feature_labels": feature_labels,
        "seeded_sample": lambda s, d: seeded_sample(_rfm(s, d), "customer_unique_id", 500, RANDOM_SEED),
        # lifetime value
        "bgnbd_inputs": lambda s, d: features.bgnbd_inputs(_rfm(s, d)),
        "p_alive": lambda s, d: rounded(clv_predict.p_alive(_rfm(s, d), BGNBD), 9, "p_alive"),
        "expected_purchases": lambda s, d: rounded(
            clv_predict.expected_purchases(_rfm(s, d), BGNBD, HORIZON_WEEKS), 8, "expected_purchases"
        ),
        "expected_profit": lambda s, d: rounded(
            clv_predict.expected_profit(_rfm(s, d), GAMMA_GAMMA), 4, "expected_profit"
        ),
        "predict_clv": lambda s, d: rounded(
            clv_predict.predict_clv(_rfm(s, d), BGNBD, GAMMA_GAMMA), 2, "predicted_clv"
        ),
        "bgnbd_fit": fitted.bgnbd_fit,
        "gamma_gamma_fit": fitted.gamma_gamma_fit,
        "clv_params_roundtrip": fitted.clv_params_roundtrip,
        # churn model
        "feature_matrix": _matrix,
        "stratified_split": lambda s, d: stratified_split(
            stage(_churn_dataset(s, d).select("customer_unique_id", "churned"), "dataset"),
            "customer_unique_id", "churned", TRAIN_RATIO, VAL_RATIO, RANDOM_SEED,
        ),
        "split_sizes": split_sizes,
        "class_weight": lambda s, d: churn_model.class_weight(_churn_dataset(s, d)),
        "standardize": fitted.standardize,
        "train_churn": fitted.train_churn,
        "predict_churn": fitted.predict_churn,
        "feature_importance": fitted.feature_importance,
        "feature_attribution": fitted.feature_attribution,
        "risk_tier": _on_predictions(lambda p: p.select("customer_unique_id", "churn_proba", "churn_risk_tier")),
        "merge_predictions": merge_predictions,
        "batch_predictions": fitted.batch_predictions,
        "train_models": fitted.train_models,
        "churn_metrics": fitted.churn_metrics,
        # evaluation
        "roc_auc": _on_scores(lambda d: rounded(evaluate.roc_auc(d, "score", "churned"), 12, "roc_auc")),
        "roc_curve": _on_scores(lambda d: evaluate.roc_curve(d, "score", "churned")),
        "average_precision": _on_scores(
            lambda d: rounded(evaluate.average_precision(d, "score", "churned"), 10, "average_precision")
        ),
        "classification_report": _on_scores(
            lambda d: rounded(
                evaluate.classification_report(d, "prediction", "churned"), 10, "precision", "recall", "f1_score"
            )
        ),
        # reports
        "filter_predictions": _on_predictions(lambda p: report.filter_predictions(p, "High", (0.0, 1000.0))),
        "customer_detail": _on_predictions(report.customer_detail),
        "kpi_cards": _on_predictions(lambda p: rounded(report.kpi_cards(p), 9, "avg_churn_proba")),
        "churn_histogram": _on_predictions(report.churn_histogram),
        "clv_histogram": _on_predictions(report.clv_histogram),
        "tier_counts": _on_predictions(report.tier_counts),
        "clv_by_tier": _on_predictions(report.clv_by_tier),
        "clv_quadrants": _on_predictions(report.clv_quadrants),
        "clv_bounds": _on_predictions(report.clv_bounds),
        "monthly_orders": lambda s, d: report.monthly_orders(raw_tables(s, d, False).orders),
        "payment_histogram": lambda s, d: report.payment_histogram(raw_tables(s, d, False).order_payments),
        "review_histogram": lambda s, d: report.review_histogram(raw_tables(s, d, False).order_reviews),
        "purchases_per_customer": _purchases,
        "repeat_share": lambda s, d: report.repeat_share(_purchases(s, d)),
        "purchase_distribution": lambda s, d: report.purchase_distribution(_purchases(s, d)),
        "recency_histogram": lambda s, d: report.recency_histogram(features.add_churn_label(_rfm(s, d), 180)),
    }
