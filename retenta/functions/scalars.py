"""Scalar column helpers shared by the operators."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from retenta.config import DELIVERED, RISK_TIERS

MONEY_UNITS = 10_000
#: Sums of wide numbers are made of parts below this, so that a long holds the sum of billions of them.
PART = 10**9


def money(name: str) -> Column:
    """An amount in whole ten-thousandths, typed so that no sum of it can overflow.

    Sums of whole units do not depend on the order of the tasks, and making them through
    a long is several times cheaper than casting each double to a decimal. NaN and infinite
    amounts have no units; they stop the job with the name of the column, as a sum of units
    could only hide them. So do amounts of 1e14 and more.
    """
    value = F.col(name).cast("double")
    wrong = F.isnan(value) | (F.abs(value) == float("inf"))
    checked = F.when(wrong, F.raise_error(F.lit(f"{name} is not a finite amount")).cast("double")).otherwise(value)
    return F.floor(checked * F.lit(float(MONEY_UNITS)) + 0.5).cast("decimal(18,0)")


def _whole(value: Column, divisor) -> Column:
    """Integral quotient towards zero, to which ``%`` gives the remainder."""
    return F.call_function("div", value, F.lit(divisor))


def money_sum(name: str) -> Column:
    """``sum(money(name))`` exactly, made of sums of two longs: decimals as wide as their sum cost much more to add."""
    units = money(name).cast("bigint")
    high, low = F.sum(_whole(units, PART)), F.sum(units % F.lit(PART))
    return (high * F.lit(Decimal(PART)) + low).cast("decimal(28,0)")


def unit_parts(units: str) -> dict[str, Column]:
    """A decimal(38,0) as three longs by name, the lower two below 1e9; see :func:`from_unit_parts`.

    Sums of the parts are exact and need no wide decimals. What fits a long is split as a long.
    """
    total, top = F.col(units), PART * PART
    short = total.try_cast("bigint")
    rest = F.when(short.isNotNull(), short % F.lit(top)).otherwise((total % F.lit(Decimal(top))).cast("bigint"))
    highest = F.when(short.isNotNull(), _whole(short, top)).otherwise(_whole(total, Decimal(top)))
    return {f"{units}_0": rest % F.lit(PART), f"{units}_1": _whole(rest, PART), f"{units}_2": highest}


def from_unit_parts(units: str) -> Column:
    """The number whose parts, or sums of parts, these are."""
    low, middle, top = (F.col(f"{units}_{k}") for k in range(3))
    return (top * F.lit(Decimal(PART * PART)) + middle * F.lit(Decimal(PART)) + low).cast("decimal(38,0)")


def amount(units: str) -> Column:
    """Back from units of :func:`money` to an amount in double."""
    return (F.col(units) * F.lit(Decimal(1) / MONEY_UNITS)).cast("double")


def mean_amount(units: str, count: str) -> Column:
    return F.try_divide(amount(units), F.col(count).cast("double"))


def mean(total: str, count: str) -> Column:
    """``total / count`` in double; null where nothing was counted."""
    return F.try_divide(F.col(total).cast("double"), F.col(count).cast("double"))


def days_between(start: Column, end: Column) -> Column:
    """Midnights passed from ``start`` to ``end``; a full 24 hours are not needed."""
    return F.datediff(F.to_date(end), F.to_date(start))


def weeks(days: str) -> Column:
    return F.col(days) / F.lit(7.0)


def repeat_count(purchases: str) -> Column:
    """Purchases after the first one; null stays null."""
    n = F.col(purchases)
    return F.when(n.isNotNull(), F.greatest(n - 1, F.lit(0).cast("bigint")))


def at_least_zero(value: Column) -> Column:
    """Clip at zero; null and NaN pass through."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(0.0)))


def present(name: str) -> Column:
    """The value as double, with NaN as null: in comparisons and maxima Spark counts NaN
    as the largest number."""
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))


def is_delivered() -> Column:
    return F.col("order_status") == DELIVERED


def inactive_flag(recency: str, window_days: int) -> Column:
    return F.when(F.col(recency) >= window_days, 1).otherwise(0)


def risk_tier(probability: str) -> Column:
    """Right-closed tiers over [0, 1]; whatever lies outside, or is NaN or null, is 'nan'."""
    p = F.col(probability)
    low, medium, high = RISK_TIERS
    return (
        F.when(p.isNull() | F.isnan(p) | (p < 0.0) | (p > 1.0), "nan")
        .when(p <= 0.33, low)
        .when(p <= 0.66, medium)
        .otherwise(high)
    )


def tier_position(tier: str) -> Column:
    """0, 1, 2 for Low, Medium, High, to list them in that order."""
    return F.array_position(F.array(*map(F.lit, RISK_TIERS)), F.col(tier)).cast("int") - 1


# Names shown for the features.
FEATURE_LABELS = {
    "monetary_value": "Total Spend (R$)",
    "avg_order_value": "Avg Order Value (R$)",
    "avg_review_score": "Avg Review Score",
    "avg_delivery_days": "Avg Delivery Days",
    "n_distinct_categories": "# Distinct Categories",
    "avg_freight_value": "Avg Freight Value (R$)",
    "used_installments": "Used Installments",
}
# End of fixed values.


def feature_label(feature: str) -> Column:
    """Display name of a feature; an unknown one keeps its own name."""
    pairs = [F.lit(text) for pair in FEATURE_LABELS.items() for text in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(feature)), F.col(feature))


def shuffled_key(id_col: str, seed: int) -> Column:
    """Text that orders rows at random, but the same way on every run and layout."""
    return F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))
