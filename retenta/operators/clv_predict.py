"""Lifetime-value predictions per person, from fitted or given parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retenta.config import CLV_MONTHS
from retenta.functions import clv
from retenta.functions.clv import BGNBDParams, GammaGammaParams
from retenta.operators.features import bgnbd_inputs

HISTORY = ("repeat_purchases", "recency_weeks", "age_weeks")


def _history(inputs: DataFrame) -> tuple:
    return tuple(inputs[name].cast("double") for name in HISTORY)


def p_alive(features: DataFrame, params: BGNBDParams) -> DataFrame:
    inputs = bgnbd_inputs(features)
    return inputs.select("customer_unique_id", clv.p_alive(*_history(inputs), params).alias("p_alive"))


def expected_purchases(features: DataFrame, params: BGNBDParams, horizon_weeks: float) -> DataFrame:
    inputs = bgnbd_inputs(features)
    expected = clv.expected_purchases(*_history(inputs), params, horizon_weeks)
    return inputs.select("customer_unique_id", expected.alias("expected_purchases"))


def expected_profit(features: DataFrame, params: GammaGammaParams) -> DataFrame:
    inputs = bgnbd_inputs(features)
    profit = clv.expected_profit(_history(inputs)[0], F.col("monetary_value"), params)
    return inputs.select("customer_unique_id", profit.alias("expected_profit"))


def predict_clv(
    features: DataFrame, bgnbd: BGNBDParams, gamma_gamma: GammaGammaParams, months: int = CLV_MONTHS
) -> DataFrame:
    """``customer_unique_id``, ``predicted_clv`` over the next ``months`` months."""
    inputs = bgnbd_inputs(features)
    value = clv.lifetime_value(*_history(inputs), F.col("monetary_value"), bgnbd, gamma_gamma, months)
    return inputs.select("customer_unique_id", value.alias("predicted_clv"))
