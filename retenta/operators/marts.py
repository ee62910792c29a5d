"""Marts on top of the per-person order metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retenta.config import INACTIVITY_DAYS
from retenta.functions.scalars import days_between, inactive_flag, repeat_count
from retenta.operators.features import with_snapshot


def mart_rfm_features(customer_orders: DataFrame) -> DataFrame:
    snapshot = F.col("snapshot_date")
    return with_snapshot(customer_orders).select(
        "customer_unique_id",
        "snapshot_date",
        days_between(F.col("last_purchase_date"), snapshot).alias("recency_days"),
        F.col("total_orders").alias("frequency"),
        F.col("total_revenue").alias("monetary_value"),
        "avg_order_value",
        "avg_review_score",
        "avg_delivery_days",
        "customer_lifespan_days",
        days_between(F.col("first_purchase_date"), snapshot).alias("customer_age_days"),
        "first_purchase_date",
        "last_purchase_date",
    )


def mart_clv_features(rfm: DataFrame) -> DataFrame:
    """Inputs of the lifetime-value models, in weeks; persons of age zero are left out."""
    spend, orders = F.col("monetary_value"), F.col("frequency")
    return rfm.filter(F.col("customer_age_days") > 0).select(
        "customer_unique_id",
        "snapshot_date",
        repeat_count("frequency").alias("frequency"),
        (days_between(F.col("first_purchase_date"), F.col("last_purchase_date")) / F.lit(7.0)).alias("recency_weeks"),
        (F.col("customer_age_days") / F.lit(7.0)).alias("T_weeks"),
        F.when(orders > 1, F.try_divide(spend, orders.cast("double"))).otherwise(spend).alias("monetary_value"),
        spend.alias("total_revenue"),
    )


def mart_churn_labels(rfm: DataFrame, inactivity_days: int = INACTIVITY_DAYS) -> DataFrame:
    return rfm.select(
        "customer_unique_id",
        "snapshot_date",
        "recency_days",
        "frequency",
        "monetary_value",
        "avg_order_value",
        "avg_review_score",
        "avg_delivery_days",
        "customer_age_days",
        "customer_lifespan_days",
        "first_purchase_date",
        "last_purchase_date",
        inactive_flag("recency_days", inactivity_days).alias("churned"),
    )
