"""Reporting aggregates over predictions, orders and payments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retenta.config import RISK_TIERS
from retenta.functions.scalars import amount, mean, mean_amount, money, present, tier_position
from retenta.operators.orders import purchase_day
from retenta.operators.ranking import exact_percentiles


def tiers_in_order(rows: DataFrame) -> DataFrame:
    """Left-join ``rows`` to the three tiers, so that a missing tier stays as nulls."""
    tiers = F.array(*map(F.lit, RISK_TIERS))
    listed = rows.sparkSession.range(1).select(F.explode(tiers).alias("churn_risk_tier"))
    return listed.join(rows, "churn_risk_tier", "left").orderBy(tier_position("churn_risk_tier"))


def filter_predictions(
    predictions: DataFrame, tier: str = "All", clv_range: tuple[float, float] | None = None
) -> DataFrame:
    out = predictions
    if tier != "All":
        out = out.filter(F.col("churn_risk_tier") == tier)
    if clv_range is not None:
        out = out.filter(F.col("predicted_clv").between(*clv_range))
    return out


def customer_detail(predictions: DataFrame) -> DataFrame:
    """Highest probability first; the sort is by range over all tasks."""
    return predictions.select(
        "customer_unique_id", "churn_proba", "churn_risk_tier", "predicted_clv"
    ).orderBy(present("churn_proba").desc_nulls_last(), "customer_unique_id")


def kpi_cards(predictions: DataFrame) -> DataFrame:
    high = F.col("churn_risk_tier") == "High"
    totals = predictions.agg(
        F.count("*").alias("total_customers"),
        F.avg(present("churn_proba")).alias("avg_churn_proba"),
        F.count(F.when(high, 1)).alias("high_risk_count"),
        F.coalesce(F.sum(F.when(high, money("predicted_clv"))), F.lit(0)).alias("at_risk"),
    )
    return totals.select(
        "total_customers", "avg_churn_proba", "high_risk_count", amount("at_risk").alias("revenue_at_risk")
    )


def tier_counts(predictions: DataFrame) -> DataFrame:
    return tiers_in_order(predictions.groupBy("churn_risk_tier").agg(F.count("*").alias("n_customers")))


def _with_value(predictions: DataFrame) -> DataFrame:
    return predictions.filter(present("predicted_clv") > 0)


def clv_by_tier(predictions: DataFrame) -> DataFrame:
    totals = (
        _with_value(predictions)
        .groupBy("churn_risk_tier")
        .agg(F.sum(money("predicted_clv")).alias("clv"), F.count("predicted_clv").alias("n_customers"))
        .select(
            "churn_risk_tier",
            mean_amount("clv", "n_customers").alias("avg_clv"),
            amount("clv").alias("total_clv"),
            "n_customers",
        )
    )
    return tiers_in_order(totals)


def clv_quadrants(predictions: DataFrame, proba_split: float = 0.5) -> DataFrame:
    """Customers with value, by churn side and by the median value of all of them."""
    rows = _with_value(predictions)
    median = exact_percentiles(rows, [], "predicted_clv", {"median_clv": 0.5})
    likely = F.col("churn_proba") >= proba_split
    valuable = F.col("predicted_clv") >= F.col("median_clv")
    quadrant = (
        F.when(~likely & valuable, "Safe — High Value")
        .when(likely & valuable, "Danger — High Value")
        .when(~likely, "Safe — Low Value")
        .otherwise("Monitor — Low Value")
    )
    return rows.crossJoin(F.broadcast(median)).select(
        "customer_unique_id", "churn_proba", "predicted_clv", "median_clv", quadrant.alias("quadrant")
    )


def clv_bounds(predictions: DataFrame) -> DataFrame:
    value = present("predicted_clv")
    return predictions.agg(F.min(value).alias("min_clv"), F.max(value).alias("max_clv"))


def histogram(
    df: DataFrame,
    value: str,
    bins: int,
    by: list[str] | None = None,
    value_range: tuple[float, float] | None = None,
) -> DataFrame:
    """Counts in ``bins`` bins of equal width, by ``by``; the last bin is closed.

    Without ``value_range`` the bins span the data. Empty bins are not listed. A value that
    no bin can hold (infinite, or outside a given range) stops the job.
    """
    by = by or []
    v = present(value)
    rows = df.filter(v.isNotNull()).select(v.alias("v"), *by)
    if value_range is None:
        span = rows.agg(F.min("v").alias("low"), F.max("v").alias("high"))
        rows = rows.crossJoin(F.broadcast(span))
    else:
        rows = rows.withColumns({"low": F.lit(float(value_range[0])), "high": F.lit(float(value_range[1]))})
    width = (F.col("high") - F.col("low")) / float(bins)
    held = F.col("v").between(F.col("low"), F.col("high")) & (F.abs("v") != float("inf"))
    wrong = F.raise_error(F.concat(F.lit(f"{value} has a value outside of all bins: "), F.col("v").cast("string")))
    step = F.floor(F.try_divide(F.when(held, F.col("v") - F.col("low")).otherwise(wrong.cast("double")), width))
    index = F.least(F.greatest(F.coalesce(step, F.lit(0)), F.lit(0)), F.lit(bins - 1)).cast("int")
    return (
        rows.groupBy(index.alias("bin"), *by, "low", "high")
        .agg(F.count("*").alias("n"))
        .select("bin", (F.col("low") + F.col("bin") * width).alias("bin_start"), *by, "n")
    )


def churn_histogram(predictions: DataFrame) -> DataFrame:
    return histogram(predictions, "churn_proba", 60, by=["churn_risk_tier"], value_range=(0.0, 1.0))


def clv_histogram(predictions: DataFrame) -> DataFrame:
    return histogram(_with_value(predictions), "predicted_clv", 50)


def payment_histogram(payments: DataFrame) -> DataFrame:
    return histogram(payments, "payment_value", 80)


def review_histogram(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("review_score").agg(F.count("*").alias("n"))


def recency_histogram(labelled: DataFrame) -> DataFrame:
    return histogram(labelled, "recency_days", 60, by=["churned"])


def monthly_orders(orders: DataFrame) -> DataFrame:
    """Orders per month, named by its last day; months without orders count zero."""
    months = orders.groupBy(F.last_day(purchase_day()).alias("month_end")).agg(F.count("*").alias("order_count"))
    months = months.filter(F.col("month_end").isNotNull())
    first_day = F.trunc("month_end", "month")
    calendar = months.agg(F.min(first_day).alias("first"), F.max(first_day).alias("last")).select(
        F.explode(F.sequence("first", "last", F.expr("interval 1 month"))).alias("first_day")
    )
    return (
        calendar.select(F.last_day("first_day").alias("month_end"))
        .join(months, "month_end", "left")
        .select("month_end", F.coalesce("order_count", F.lit(0).cast("bigint")).alias("order_count"))
        .orderBy("month_end")
    )


def purchases_per_customer(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders of any status per person, counted per customer before customers join."""
    per_customer = orders.groupBy("customer_id").agg(F.count("*").alias("n"))
    return (
        per_customer.join(customers.select("customer_id", "customer_unique_id"), "customer_id")
        .groupBy("customer_unique_id")
        .agg(F.sum("n").alias("n_purchases"))
    )


def repeat_share(purchases: DataFrame) -> DataFrame:
    n = F.col("n_purchases")
    totals = purchases.agg(
        F.count("*").alias("n_customers"),
        F.count(F.when(n == 1, 1)).alias("n_single"),
        F.count(F.when(n >= 2, 1)).alias("n_repeat"),
    )
    return totals.select(
        "n_single",
        mean("n_single", "n_customers").alias("single_share"),
        "n_repeat",
        mean("n_repeat", "n_customers").alias("repeat_share"),
    )


def purchase_distribution(purchases: DataFrame, cap: int = 10) -> DataFrame:
    """Persons by number of purchases, with ``cap`` and more in one row."""
    capped: Column = F.least("n_purchases", F.lit(cap).cast("bigint"))
    label = F.when(F.col("n_purchases") == cap, f"{cap}+").otherwise(F.col("n_purchases").cast("string"))
    return (
        purchases.groupBy(capped.alias("n_purchases"))
        .agg(F.count("*").alias("n_customers"))
        .withColumn("label", label)
        .orderBy("n_purchases")
    )
