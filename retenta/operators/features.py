"""Customer features: RFM, behaviour, and the temporal churn dataset."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retenta.config import ALIVE_THRESHOLD, CHURN_CUTOFF_DATE, CHURN_WINDOW_DAYS, FEATURE_COLS
from retenta.functions.clv import BGNBDParams, p_alive
from retenta.functions.scalars import (
    amount,
    days_between,
    from_unit_parts,
    inactive_flag,
    mean,
    mean_amount,
    money,
    repeat_count,
    unit_parts,
    weeks,
)
from retenta.operators.orders import FANOUT_SUMS, delivered_orders, order_basket_rows, purchase_day
from retenta.operators.sharing import computed_once


def with_snapshot(per_person: DataFrame, last_date: str = "last_purchase_date") -> DataFrame:
    """Add the latest date of all rows as ``snapshot_date``.

    The maximum is one row, so broadcasting it is bounded. Both uses of ``per_person``
    share one computation.
    """
    rows = computed_once(per_person)
    newest = rows.agg(F.max(last_date).alias("snapshot_date"))
    return rows.crossJoin(F.broadcast(newest))


def rfm_features(orders: DataFrame, customers: DataFrame, payments: DataFrame) -> DataFrame:
    """Recency, frequency (distinct purchase days) and spend per person over all history.

    Payments are summed per order, then per customer and day, and only then do customers
    join: a busy customer is at most one row per calendar day there, and counting distinct
    days is counting rows.
    """
    paid = payments.groupBy("order_id").agg(F.sum(money("payment_value")).alias("spend"))
    customer_days = (
        delivered_orders(orders)
        .select("order_id", "customer_id", purchase_day().alias("purchase_date"))
        .join(paid, "order_id")
        .groupBy("customer_id", "purchase_date")
        .agg(F.sum("spend").alias("spend"))
    )
    person_days = (
        customer_days.join(customers.select("customer_id", "customer_unique_id"), "customer_id")
        .groupBy("customer_unique_id", "purchase_date")
        .agg(F.sum("spend").alias("spend"))
    )
    per_person = person_days.groupBy("customer_unique_id").agg(
        F.count("purchase_date").alias("frequency"),
        F.sum("spend").alias("spend"),
        F.min("purchase_date").alias("first_purchase_date"),
        F.max("purchase_date").alias("last_purchase_date"),
    )
    first, last = F.col("first_purchase_date"), F.col("last_purchase_date")
    snapshot = F.col("snapshot_date")
    return with_snapshot(per_person).select(
        "customer_unique_id",
        "snapshot_date",
        days_between(last, snapshot).alias("recency_days"),
        "frequency",
        amount("spend").alias("monetary_value"),
        "first_purchase_date",
        "last_purchase_date",
        days_between(first, snapshot).alias("customer_age_days"),
        days_between(first, last).alias("customer_lifespan_days"),
    )


def snapshot_date(orders: DataFrame, customers: DataFrame, payments: DataFrame) -> DataFrame:
    """Latest purchase day among delivered, paid orders of known customers."""
    return (
        delivered_orders(orders)
        .select("order_id", "customer_id", purchase_day().alias("purchase_date"))
        .join(payments.select("order_id").distinct(), "order_id", "left_semi")
        .groupBy("customer_id")
        .agg(F.max("purchase_date").alias("purchase_date"))
        .join(customers.select("customer_id"), "customer_id", "left_semi")
        .agg(F.max("purchase_date").alias("snapshot_date"))
    )


def _behavior_columns() -> list:
    return [
        mean_amount("payment_total", "n_payments").alias("avg_order_value"),
        mean("score_total", "n_scores").alias("avg_review_score"),
        mean("delivery_total", "n_deliveries").alias("avg_delivery_days"),
        "n_distinct_categories",
        mean_amount("freight_total", "n_freights").alias("avg_freight_value"),
        "used_installments",
    ]


#: Measures of a basket row, and those of a person's totals that are wide decimals.
MEASURES = ("purchase_date", "used_installments", *FANOUT_SUMS)
AMOUNTS = ("payment_total", "freight_total")
TOTALS = ("first_purchase_date", "last_purchase_date", "n_distinct_categories", "used_installments", *FANOUT_SUMS)
#: Before the names of totals over the rows before the cutoff, where a frame has totals over all rows too.
OBSERVED = "observed_"


def _person_totals(
    rows: DataFrame, customers: DataFrame, extra_max: tuple[str, ...] = (), prefixes: tuple[str, ...] = ("",)
) -> DataFrame:
    """Sum basket rows up to persons, keeping (person, category) groups on the way.

    Grouping by category first spreads a busy customer over several tasks, and turns the
    distinct count into a plain count, with no expansion of the rows. There is one set of
    totals per prefix, over the rows where the measures with that prefix are not null.
    """
    sums, most, least, counts = [], list(extra_max), [], []
    for p in prefixes:
        sums += [f"{p}{name}" for name in FANOUT_SUMS if name not in AMOUNTS]
        sums += [part for name in AMOUNTS for part in unit_parts(f"{p}{name}")]
        most += [f"{p}used_installments", f"{p}last_purchase_date"]
        least += [f"{p}first_purchase_date"]
        counted = F.when(F.col(f"{p}last_purchase_date").isNotNull(), F.col("category")) if p else F.col("category")
        counts.append(F.count(counted).alias(f"{p}n_distinct_categories"))
    merge = [how(name).alias(name) for how, names in ((F.sum, sums), (F.max, most), (F.min, least)) for name in names]
    dates = {f"{p}{end}_purchase_date": F.col(f"{p}purchase_date") for p in prefixes for end in ("first", "last")}
    parts = {name: part for p in prefixes for units in AMOUNTS for name, part in unit_parts(f"{p}{units}").items()}
    totals = (
        rows.withColumns(dates | parts)
        .groupBy("customer_id", "category")
        .agg(*merge)
        .join(customers.select("customer_id", "customer_unique_id"), "customer_id")
        .groupBy("customer_unique_id", "category")
        .agg(*merge)
        .groupBy("customer_unique_id")
        .agg(*merge, *counts)
    )
    whole = {f"{p}{units}": from_unit_parts(f"{p}{units}") for p in prefixes for units in AMOUNTS}
    names = [f"{p}{name}" for p in prefixes for name in TOTALS]
    return totals.withColumns(whole).select("customer_unique_id", *extra_max, *names)


def behavioral_features(
    orders: DataFrame,
    customers: DataFrame,
    payments: DataFrame,
    items: DataFrame,
    reviews: DataFrame,
    products: DataFrame,
) -> DataFrame:
    """RFM and behaviour per person over all history; frequency counts orders.

    Sums and means run over the joined payments x items x reviews rows of each order, so
    ``monetary_value`` counts a payment once per item and review, as the definition says.
    """
    rows = order_basket_rows(
        delivered_orders(orders), payments, items, reviews, products, keep_without_items=True
    )
    return _behavior(_person_totals(rows, customers))


def _behavior(per_person: DataFrame) -> DataFrame:
    first, last = F.col("first_purchase_date"), F.col("last_purchase_date")
    snapshot = F.col("snapshot_date")
    return with_snapshot(per_person).select(
        "customer_unique_id",
        "snapshot_date",
        days_between(last, snapshot).alias("recency_days"),
        F.col("n_orders").alias("frequency"),
        amount("payment_total").alias("monetary_value"),
        days_between(first, snapshot).alias("customer_age_days"),
        days_between(first, last).alias("customer_lifespan_days"),
        "first_purchase_date",
        "last_purchase_date",
        *_behavior_columns(),
    )


def _window_end(cutoff_date: str, churn_window_days: int) -> tuple[date, date]:
    cutoff = date.fromisoformat(cutoff_date)
    return cutoff, cutoff + timedelta(days=churn_window_days)


def churn_dataset(
    orders: DataFrame,
    customers: DataFrame,
    payments: DataFrame,
    items: DataFrame,
    reviews: DataFrame,
    products: DataFrame,
    cutoff_date: str = CHURN_CUTOFF_DATE,
    churn_window_days: int = CHURN_WINDOW_DAYS,
) -> DataFrame:
    """Features from before the cutoff, and a label from the window that follows it.

    ``churned`` is 1 where a person bought nothing in ``churn_window_days`` days from the
    cutoff on. Both windows come out of one pass: orders of the outcome window carry no
    measures and no category, only the flag that their person is still active.
    """
    cutoff, end = _window_end(cutoff_date, churn_window_days)
    rows = order_basket_rows(
        delivered_orders(orders, before=end), payments, items, reviews, products, keep_without_items=False
    )
    observed = F.col("purchase_date") < F.lit(cutoff)
    rows = rows.select(
        "customer_id",
        F.when(~observed, 1).alias("active_after"),
        *[F.when(observed, F.col(name)).alias(name) for name in ("category", *MEASURES)],
    )
    return _labelled(_person_totals(rows, customers, extra_max=("active_after",)), cutoff)


def _labelled(per_person: DataFrame, cutoff: date) -> DataFrame:
    at = F.lit(cutoff)
    return (
        per_person.filter(F.col("n_orders") > 0)
        .select(
            "customer_unique_id",
            at.alias("cutoff_date"),
            days_between(F.col("last_purchase_date"), at).alias("recency_days"),
            F.col("n_orders").alias("frequency"),
            amount("payment_total").alias("monetary_value"),
            "first_purchase_date",
            "last_purchase_date",
            days_between(F.col("first_purchase_date"), at).alias("customer_age_days"),
            *_behavior_columns(),
            F.when(F.col("active_after").isNull(), 1).otherwise(0).alias("churned"),
        )
    )


def history_totals(
    orders: DataFrame,
    customers: DataFrame,
    payments: DataFrame,
    items: DataFrame,
    reviews: DataFrame,
    products: DataFrame,
    cutoff_date: str = CHURN_CUTOFF_DATE,
    churn_window_days: int = CHURN_WINDOW_DAYS,
) -> DataFrame:
    """One pass for both feature sets: totals per person over all history, and over what the churn dataset observes.

    Write them and give them to :func:`behavior_of_totals` and :func:`churn_dataset_of_totals`.
    """
    cutoff, end = _window_end(cutoff_date, churn_window_days)
    rows = order_basket_rows(
        delivered_orders(orders), payments, items, reviews, products, keep_without_items=True, sold_before=end
    )
    early = F.col("purchase_date") < F.lit(cutoff)
    rows = rows.select(
        "customer_id",
        "category",
        F.when(F.col("sold") & ~early, 1).alias("active_after"),
        *MEASURES,
        *[F.when(F.col("sold") & early, F.col(name)).alias(OBSERVED + name) for name in MEASURES],
    )
    return _person_totals(rows, customers, extra_max=("active_after",), prefixes=("", OBSERVED))


def behavior_of_totals(totals: DataFrame) -> DataFrame:
    """:func:`behavioral_features` from :func:`history_totals`."""
    return _behavior(totals.select("customer_unique_id", *TOTALS))


def churn_dataset_of_totals(totals: DataFrame, cutoff_date: str = CHURN_CUTOFF_DATE) -> DataFrame:
    """:func:`churn_dataset` from :func:`history_totals` of the same cutoff and window."""
    observed = [F.col(OBSERVED + name).alias(name) for name in TOTALS]
    return _labelled(totals.select("customer_unique_id", "active_after", *observed), date.fromisoformat(cutoff_date))


def active_after_cutoff(
    orders: DataFrame,
    customers: DataFrame,
    payments: DataFrame,
    items: DataFrame,
    cutoff_date: str = CHURN_CUTOFF_DATE,
    churn_window_days: int = CHURN_WINDOW_DAYS,
) -> DataFrame:
    """Persons with a delivered, paid order holding items in the outcome window.

    The ids to look up are made distinct first: a semi join cannot split a hot key on its
    right side, and this way such a key is one row per task.
    """
    cutoff, end = _window_end(cutoff_date, churn_window_days)
    return (
        delivered_orders(orders, before=end, since=cutoff)
        .select("order_id", "customer_id")
        .join(payments.select("order_id").distinct(), "order_id", "left_semi")
        .join(items.select("order_id").distinct(), "order_id", "left_semi")
        .select("customer_id")
        .distinct()
        .join(customers.select("customer_id", "customer_unique_id"), "customer_id")
        .select("customer_unique_id")
        .distinct()
    )


def churn_rate(labelled: DataFrame) -> DataFrame:
    totals = labelled.agg(F.count("*").alias("n_customers"), F.sum("churned").alias("n_churned"))
    return totals.select("n_customers", mean("n_churned", "n_customers").alias("churn_rate"))


def add_churn_label(features: DataFrame, churn_window_days: int = CHURN_WINDOW_DAYS) -> DataFrame:
    """1 where nothing was bought for ``churn_window_days`` days or more."""
    return features.withColumn("churned", inactive_flag("recency_days", churn_window_days))


def bgnbd_inputs(features: DataFrame) -> DataFrame:
    """Repeat purchases and, in weeks, the age at the last purchase and the age."""
    return features.select(
        "customer_unique_id",
        repeat_count("frequency").alias("repeat_purchases"),
        weeks("customer_lifespan_days").alias("recency_weeks"),
        weeks("customer_age_days").alias("age_weeks"),
        "monetary_value",
    )


def add_alive_label(features: DataFrame, params: BGNBDParams, threshold: float = ALIVE_THRESHOLD) -> DataFrame:
    """Add ``p_alive`` and ``churned`` (1 where it is below the threshold)."""
    alive = p_alive(
        repeat_count("frequency").cast("double"),
        weeks("customer_lifespan_days"),
        weeks("customer_age_days"),
        params,
    )
    return features.withColumn("p_alive", alive).withColumn(
        "churned", (F.col("p_alive") < threshold).cast("int")
    )


def feature_matrix(behavioral: DataFrame, params: BGNBDParams) -> DataFrame:
    """Id, the seven model features, and the label from the probability of being alive.

    Recency, frequency and age define the label, so they are kept out of the features.
    """
    return add_alive_label(behavioral, params).select("customer_unique_id", *FEATURE_COLS, "churned")
