"""Per-order sums and the order-grain frame built from them.

Payments, items and reviews can each hold many rows for one order, and one order can
hold a large share of a table. Every child table is therefore summed per order first:
the partial sums run before the shuffle, and the joins on ``order_id`` are one row to
one row, on data that is already partitioned by ``order_id``.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retenta.functions.scalars import amount, days_between, is_delivered, mean, mean_amount, money, money_sum


def purchase_day() -> Column:
    return F.to_date("order_purchase_timestamp")


def delivered_orders(orders: DataFrame, before: date | None = None, since: date | None = None) -> DataFrame:
    """Delivered orders, by choice bought on or after ``since`` and before ``before``.

    The bounds compare the timestamp itself, so that they reach the file scan.
    """
    out = orders.filter(is_delivered())
    bought = F.col("order_purchase_timestamp")
    if before is not None:
        out = out.filter(bought < F.lit(before.isoformat()).cast("timestamp_ntz"))
    if since is not None:
        out = out.filter(bought >= F.lit(since.isoformat()).cast("timestamp_ntz"))
    return out


def _delivery_days() -> Column:
    arrived = F.coalesce("order_delivered_customer_date", "order_estimated_delivery_date")
    return days_between(F.col("order_purchase_timestamp"), arrived)


# --- order-grain models, without fan-out --------------------------------------------


def _revenue_units(stg_payments: DataFrame) -> DataFrame:
    return stg_payments.groupBy("order_id").agg(F.sum(money("payment_value")).alias("order_revenue"))


def order_revenue(stg_payments: DataFrame) -> DataFrame:
    return _revenue_units(stg_payments).select("order_id", amount("order_revenue").alias("order_revenue"))


def order_reviews(stg_reviews: DataFrame) -> DataFrame:
    sums = stg_reviews.groupBy("order_id").agg(
        F.sum("review_score").alias("score_total"), F.count("review_score").alias("n_scores")
    )
    return sums.select("order_id", mean("score_total", "n_scores").alias("avg_review_score"))


def _enriched_orders(stg_orders: DataFrame, stg_payments: DataFrame, stg_reviews: DataFrame) -> DataFrame:
    return (
        stg_orders.filter(is_delivered())
        .join(_revenue_units(stg_payments), "order_id", "left")
        .join(order_reviews(stg_reviews), "order_id", "left")
        .select(
            "order_id",
            "customer_id",
            "order_status",
            "order_purchase_at",
            "order_delivered_at",
            F.coalesce("order_revenue", F.lit(0).cast("decimal(28,0)")).alias("order_revenue"),
            "avg_review_score",
            days_between(
                F.col("order_purchase_at"), F.coalesce("order_delivered_at", "order_estimated_delivery_at")
            ).alias("delivery_days"),
        )
    )


def order_enriched(
    stg_orders: DataFrame, stg_customers: DataFrame, stg_payments: DataFrame, stg_reviews: DataFrame
) -> DataFrame:
    """Delivered orders with revenue, mean review score and delivery days."""
    return (
        _enriched_orders(stg_orders, stg_payments, stg_reviews)
        .join(stg_customers.select("customer_id", "customer_unique_id"), "customer_id")
        .withColumn("order_revenue", amount("order_revenue"))
        .drop("customer_id")
    )


def int_customer_orders(
    stg_orders: DataFrame, stg_customers: DataFrame, stg_payments: DataFrame, stg_reviews: DataFrame
) -> DataFrame:
    """Order metrics per person; an order counts once, however often its row is repeated.

    Orders are summed per ``customer_id`` before the customers are joined, so a customer
    with very many orders meets the join as a single row.
    """
    of_order = Window.partitionBy("order_id", "customer_id").orderBy("order_purchase_at")
    sums = {
        "total_orders": F.count(F.when(F.col("row_in_order") == 1, F.col("order_id"))),
        "total_revenue": F.sum("order_revenue"),
        "n_orders": F.count("*"),
        # A fixed scale keeps the sum of the order means free of rounding by task order.
        "score_total": F.sum(F.col("avg_review_score").cast("decimal(20,10)")),
        "n_scores": F.count("avg_review_score"),
        "delivery_total": F.sum("delivery_days"),
        "n_deliveries": F.count("delivery_days"),
    }
    per_customer = (
        _enriched_orders(stg_orders, stg_payments, stg_reviews)
        .withColumn("row_in_order", F.row_number().over(of_order))
        .groupBy("customer_id")
        .agg(
            *[column.alias(name) for name, column in sums.items()],
            F.min("order_purchase_at").alias("first_purchase_at"),
            F.max("order_purchase_at").alias("last_purchase_at"),
        )
    )
    per_person = (
        per_customer.join(stg_customers.select("customer_id", "customer_unique_id"), "customer_id")
        .groupBy("customer_unique_id")
        .agg(
            *[F.sum(name).alias(name) for name in sums],
            F.min("first_purchase_at").alias("first_purchase_at"),
            F.max("last_purchase_at").alias("last_purchase_at"),
        )
    )
    return per_person.select(
        "customer_unique_id",
        "total_orders",
        amount("total_revenue").alias("total_revenue"),
        mean_amount("total_revenue", "n_orders").alias("avg_order_value"),
        mean("score_total", "n_scores").alias("avg_review_score"),
        mean("delivery_total", "n_deliveries").alias("avg_delivery_days"),
        F.to_date("first_purchase_at").alias("first_purchase_date"),
        F.to_date("last_purchase_at").alias("last_purchase_date"),
        days_between(F.col("first_purchase_at"), F.col("last_purchase_at")).alias("customer_lifespan_days"),
    )


# --- the fan-out of payments x items x reviews, counted and not built ----------------

FANOUT_SUMS = (
    "n_orders",
    "payment_total",
    "n_payments",
    "score_total",
    "n_scores",
    "delivery_total",
    "n_deliveries",
    "freight_total",
    "n_freights",
)


def order_basket_rows(
    orders: DataFrame,
    payments: DataFrame,
    items: DataFrame,
    reviews: DataFrame,
    products: DataFrame,
    keep_without_items: bool,
    sold_before: date | None = None,
) -> DataFrame:
    """One row per order and product category, carrying the sums of the full join.

    Joining payments, items and reviews to an order multiplies their rows. All sums over
    that product are products of per-order sums: each payment appears once per item and
    review of its order, and so on. So the joined rows are never made; ``FANOUT_SUMS``
    hold what summing them would give. The category stays a row key, which lets distinct
    categories be counted later by grouping. An order in several categories counts once
    in ``n_orders``, on the first of its rows.

    ``sold_before`` adds the flag ``sold``: bought before that day, with items. An order's
    rows with the flag come first, so ``n_orders`` counts it among them and among all rows.
    """
    per_order_payments = payments.groupBy("order_id").agg(
        F.count("*").alias("k_payments"),
        F.count("payment_value").alias("k_values"),
        money_sum("payment_value").alias("values_sum"),
        F.max(F.when(F.col("payment_installments") > 1, 1).otherwise(0)).alias("used_installments"),
    )
    per_order_reviews = reviews.groupBy("order_id").agg(
        F.count("*").alias("k_reviews"),
        F.count("review_score").alias("k_scores"),
        F.sum("review_score").alias("scores_sum"),
    )
    category = F.col("product_category_name").alias("category")
    baskets = (
        items.select("order_id", "product_id", "freight_value")
        .join(products.select("product_id", "product_category_name"), "product_id", "left")
        .groupBy("order_id", category)
        .agg(
            F.count("*").alias("k_items"),
            F.count("freight_value").alias("k_freights"),
            money_sum("freight_value").alias("freights_sum"),
        )
    )
    joined = (
        orders.select("order_id", "customer_id", purchase_day().alias("purchase_date"), _delivery_days().alias("days"))
        .join(per_order_payments, "order_id")
        .join(per_order_reviews, "order_id", "left")
        .join(baskets, "order_id", "left" if keep_without_items else "inner")
    )
    # The joins leave the rows partitioned by order. A repeated order row counts no order again.
    first, flags = [F.col("category")], []
    if sold_before is not None:
        sold = F.coalesce(F.col("purchase_date") < F.lit(sold_before), F.lit(False)) & F.col("k_items").isNotNull()
        joined = joined.withColumn("sold", sold)
        first, flags = [F.desc("sold"), *first], ["sold"]
    of_order = Window.partitionBy("order_id", "customer_id").orderBy(*first)
    joined = joined.withColumn("row_in_order", F.row_number().over(of_order))
    k_payments = F.col("k_payments")
    k_items = F.coalesce("k_items", F.lit(1).cast("bigint"))
    k_reviews = F.coalesce("k_reviews", F.lit(1).cast("bigint"))
    on_time_axis = F.when(F.col("days") >= 0, k_payments * k_items * k_reviews)
    return joined.select(
        "customer_id",
        "category",
        "purchase_date",
        "used_installments",
        *flags,
        F.when(F.col("row_in_order") == 1, 1).otherwise(0).cast("bigint").alias("n_orders"),
        (F.col("values_sum") * (k_items * k_reviews)).alias("payment_total"),
        (F.col("k_values") * k_items * k_reviews).alias("n_payments"),
        (F.col("scores_sum") * k_payments * k_items).alias("score_total"),
        (F.coalesce("k_scores", F.lit(0).cast("bigint")) * k_payments * k_items).alias("n_scores"),
        (F.col("days") * on_time_axis).alias("delivery_total"),
        F.coalesce(on_time_axis, F.lit(0).cast("bigint")).alias("n_deliveries"),
        (F.col("freights_sum") * (k_payments * k_reviews)).alias("freight_total"),
        (F.coalesce("k_freights", F.lit(0).cast("bigint")) * k_payments * k_reviews).alias("n_freights"),
    )
