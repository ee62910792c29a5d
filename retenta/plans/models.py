"""Build of the SQL models: staging as views, per-order metrics inline, marts as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from retenta.operators import marts, staging
from retenta.operators.orders import int_customer_orders
from retenta.sources.retail import RawTables


def staging_models(tables: RawTables) -> dict[str, DataFrame]:
    return {
        "stg_orders": staging.stg_orders(tables.orders),
        "stg_customers": staging.stg_customers(tables.customers),
        "stg_order_items": staging.stg_order_items(tables.order_items),
        "stg_order_payments": staging.stg_order_payments(tables.order_payments),
        "stg_order_reviews": staging.stg_order_reviews(tables.order_reviews),
        "stg_products": staging.stg_products(tables.products, tables.product_category_translation),
        "stg_sellers": staging.stg_sellers(tables.sellers),
    }


def per_order_inputs(staged: dict[str, DataFrame]) -> list[DataFrame]:
    names = ("stg_orders", "stg_customers", "stg_order_payments", "stg_order_reviews")
    return [staged[name] for name in names]


def customer_orders(staged: dict[str, DataFrame]) -> DataFrame:
    return int_customer_orders(*per_order_inputs(staged))


def build_models(
    spark: SparkSession, tables: RawTables, database: str = "default", location: str | None = None
) -> dict[str, DataFrame]:
    """Register the staging views and write the marts; returns every model by name.

    The two marts on top of the RFM mart read it back as a table, so the joins beneath it
    run once for all three.
    """
    built = staging_models(tables)
    for name, view in built.items():
        view.createOrReplaceTempView(name)

    def save(name: str, mart: DataFrame) -> DataFrame:
        writer = mart.write.mode("overwrite").format("parquet")
        if location:
            writer = writer.option("path", f"{location}/{name}")
        writer.saveAsTable(f"{database}.{name}")
        return spark.table(f"{database}.{name}")

    built["int_customer_orders"] = customer_orders(built)
    rfm = save("mart_rfm_features", marts.mart_rfm_features(built["int_customer_orders"]))
    built["mart_rfm_features"] = rfm
    built["mart_clv_features"] = save("mart_clv_features", marts.mart_clv_features(rfm))
    built["mart_churn_labels"] = save("mart_churn_labels", marts.mart_churn_labels(rfm))
    return built
