"""Data-quality checks: not-null and unique, over raw, staged and mart tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The checks declared for each table, as (not null, unique) column lists.
RAW_CHECKS = {
    "raw_orders": (["order_id"], ["order_id"]),
    "raw_customers": (["customer_id"], ["customer_id"]),
    "raw_order_items": (["order_id"], []),
    "raw_order_payments": (["order_id"], []),
    "raw_order_reviews": (["review_id"], []),
    "raw_products": (["product_id"], ["product_id"]),
    "raw_sellers": (["seller_id"], ["seller_id"]),
}
STAGING_CHECKS = {
    "stg_orders": (["order_id", "customer_id", "order_status"], ["order_id"]),
    "stg_customers": (["customer_id", "customer_unique_id"], ["customer_id"]),
    "stg_order_items": (["order_id", "product_id"], []),
    "stg_order_payments": (["order_id", "payment_value"], []),
    "stg_order_reviews": (["review_id", "review_score"], ["review_id"]),
    "stg_products": (["product_id"], ["product_id"]),
    "stg_sellers": (["seller_id"], ["seller_id"]),
}
MART_CHECKS = {
    "int_customer_orders": (["customer_unique_id", "total_orders", "total_revenue"], ["customer_unique_id"]),
    "mart_rfm_features": (
        ["customer_unique_id", "recency_days", "frequency", "monetary_value", "customer_age_days"],
        ["customer_unique_id"],
    ),
    "mart_churn_labels": (["customer_unique_id", "churned"], ["customer_unique_id"]),
    "mart_clv_features": (
        ["customer_unique_id", "frequency", "recency_weeks", "T_weeks", "monetary_value"],
        ["customer_unique_id"],
    ),
}
# End of fixed values.


def null_rows(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def duplicated_keys(df: DataFrame, column: str) -> DataFrame:
    """Keys held by several rows, with their row count; null is no key."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("n_rows"))
        .filter(F.col("n_rows") > 1)
    )


def not_null_report(tables: dict[str, DataFrame], checks: dict) -> DataFrame:
    """``table_name``, ``column_name``, ``failures``; one pass per table for all columns."""
    out = None
    for table, (columns, _) in checks.items():
        counts = tables[table].agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
        cells = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("failures")) for c in columns]
        rows = counts.select(F.lit(table).alias("table_name"), F.inline(F.array(*cells)))
        out = rows if out is None else out.unionByName(rows)
    return out


def unique_report(tables: dict[str, DataFrame], checks: dict) -> DataFrame:
    """``table_name``, ``column_name``, ``failures``: keys that occur more than once."""
    out = None
    for table, (_, columns) in checks.items():
        for column in columns:
            rows = (
                duplicated_keys(tables[table], column)
                .agg(F.count("*").alias("failures"))
                .select(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), "failures")
            )
            out = rows if out is None else out.unionByName(rows)
    return out
