"""Fixed schemas of the raw tables."""

from __future__ import annotations

from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)


def _schema(**columns) -> StructType:
    return StructType([StructField(name, kind(), True) for name, kind in columns.items()])


# Column names and order of the raw files.
RAW_SCHEMAS: dict[str, StructType] = {
    "customers": _schema(
        customer_id=StringType,
        customer_unique_id=StringType,
        customer_zip_code_prefix=StringType,
        customer_city=StringType,
        customer_state=StringType,
    ),
    "orders": _schema(
        order_id=StringType,
        customer_id=StringType,
        order_status=StringType,
        order_purchase_timestamp=TimestampNTZType,
        order_approved_at=TimestampNTZType,
        order_delivered_carrier_date=TimestampNTZType,
        order_delivered_customer_date=TimestampNTZType,
        order_estimated_delivery_date=TimestampNTZType,
    ),
    "order_items": _schema(
        order_id=StringType,
        order_item_id=IntegerType,
        product_id=StringType,
        seller_id=StringType,
        shipping_limit_date=TimestampNTZType,
        price=DoubleType,
        freight_value=DoubleType,
    ),
    "order_payments": _schema(
        order_id=StringType,
        payment_sequential=IntegerType,
        payment_type=StringType,
        payment_installments=IntegerType,
        payment_value=DoubleType,
    ),
    "order_reviews": _schema(
        review_id=StringType,
        order_id=StringType,
        review_score=IntegerType,
        review_comment_title=StringType,
        review_comment_message=StringType,
        review_creation_date=TimestampNTZType,
        review_answer_timestamp=TimestampNTZType,
    ),
    "products": _schema(
        product_id=StringType,
        product_category_name=StringType,
        product_name_lenght=IntegerType,
        product_description_lenght=IntegerType,
        product_photos_qty=IntegerType,
        product_weight_g=IntegerType,
        product_length_cm=IntegerType,
        product_height_cm=IntegerType,
        product_width_cm=IntegerType,
    ),
    "sellers": _schema(
        seller_id=StringType,
        seller_zip_code_prefix=StringType,
        seller_city=StringType,
        seller_state=StringType,
    ),
    "geolocation": _schema(
        geolocation_zip_code_prefix=StringType,
        geolocation_lat=DoubleType,
        geolocation_lng=DoubleType,
        geolocation_city=StringType,
        geolocation_state=StringType,
    ),
    "product_category_translation": _schema(
        product_category_name=StringType,
        product_category_name_english=StringType,
    ),
}

PREDICTION_SCHEMA = _schema(
    customer_unique_id=StringType,
    churn_proba=DoubleType,
    churn_risk_tier=StringType,
    predicted_clv=DoubleType,
)
