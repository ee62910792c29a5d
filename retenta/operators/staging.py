"""Staging: rename and cast the raw tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _timestamp(name: str, alias: str) -> Column:
    return F.col(name).cast("timestamp_ntz").alias(alias)


def stg_orders(raw_orders: DataFrame) -> DataFrame:
    return raw_orders.select(
        "order_id",
        "customer_id",
        "order_status",
        _timestamp("order_purchase_timestamp", "order_purchase_at"),
        _timestamp("order_approved_at", "order_approved_at"),
        _timestamp("order_delivered_carrier_date", "order_carrier_at"),
        _timestamp("order_delivered_customer_date", "order_delivered_at"),
        _timestamp("order_estimated_delivery_date", "order_estimated_delivery_at"),
    )


def stg_customers(raw_customers: DataFrame) -> DataFrame:
    return raw_customers.select(
        "customer_id",
        "customer_unique_id",
        F.col("customer_zip_code_prefix").alias("customer_zip"),
        "customer_city",
        "customer_state",
    )


def stg_order_items(raw_order_items: DataFrame) -> DataFrame:
    return raw_order_items.select(
        "order_id",
        "order_item_id",
        "product_id",
        "seller_id",
        _timestamp("shipping_limit_date", "shipping_limit_at"),
        "price",
        "freight_value",
    )


def stg_order_payments(raw_order_payments: DataFrame) -> DataFrame:
    return raw_order_payments.select(
        "order_id", "payment_sequential", "payment_type", "payment_installments", "payment_value"
    )


def stg_order_reviews(raw_order_reviews: DataFrame) -> DataFrame:
    return raw_order_reviews.select(
        "review_id",
        "order_id",
        "review_score",
        "review_comment_title",
        "review_comment_message",
        _timestamp("review_creation_date", "review_created_at"),
        _timestamp("review_answer_timestamp", "review_answered_at"),
    )


def stg_products(raw_products: DataFrame, raw_translation: DataFrame) -> DataFrame:
    """Products with the English category where there is one.

    No broadcast hint: the translation is tiny in practice and Spark broadcasts it by its
    measured size, but nothing here bounds that size.
    """
    return raw_products.join(raw_translation, "product_category_name", "left").select(
        "product_id",
        F.coalesce("product_category_name_english", "product_category_name").alias("product_category"),
        F.col("product_name_lenght").alias("product_name_length"),
        F.col("product_description_lenght").alias("product_description_length"),
        "product_photos_qty",
        "product_weight_g",
        "product_length_cm",
        "product_height_cm",
        "product_width_cm",
    )


def stg_sellers(raw_sellers: DataFrame) -> DataFrame:
    return raw_sellers.select(
        "seller_id",
        F.col("seller_zip_code_prefix").alias("seller_zip"),
        "seller_city",
        "seller_state",
    )
