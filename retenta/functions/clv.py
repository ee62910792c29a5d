"""BG/NBD and Gamma-Gamma predictions as columns.

Fader, Hardie and Lee (2005), "Counting your customers the easy way", and Fader and
Hardie's note on the Gamma-Gamma model of spend. ``x`` is the number of repeat
purchases, ``t_x`` the age at the last purchase, ``T`` the age, in one time unit.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from retenta.config import CLV_DISCOUNT_RATE, CLV_MONTHS, WEEKS_PER_MONTH
from retenta.functions.scalars import at_least_zero


class BGNBDParams(NamedTuple):
    r: float
    alpha: float
    a: float
    b: float


class GammaGammaParams(NamedTuple):
    p: float
    q: float
    v: float


def _dropout_odds(x: Column, t_x: Column, T: Column, m: BGNBDParams) -> Column:
    """Odds that the customer left right after the last purchase; zero without repeats."""
    log_odds = (
        F.log(F.lit(m.a) / (m.b + F.greatest(x, F.lit(1.0)) - 1.0)) + (m.r + x) * F.log((m.alpha + T) / (m.alpha + t_x))
    )
    return F.when(x > 0, F.exp(log_odds)).otherwise(F.lit(0.0))


def p_alive(x: Column, t_x: Column, T: Column, m: BGNBDParams) -> Column:
    return 1.0 / (1.0 + _dropout_odds(x, t_x, T, m))


def _expectation(m: BGNBDParams, horizons: dict[float, float]):
    """UDF of (x, T): the weighted sum of the expectations up to each horizon, before the
    chance of being gone is taken off.

    The expectation holds the series 2F1(A, B; C; z), A = r+x, B = b+x, C = a+b+x-1. By
    Euler it is (1-z)^(C-A-B) 2F1(C-A, C-B; C; z), whose terms fall quickly, and the model's
    own ((alpha+T)/(alpha+T+h))^(r+x) cancels that power down to a-1. Terms are added over
    a whole Arrow batch until the slowest row no longer changes, so nothing is cut off. As
    a native expression the loop is a lambda that runs interpreted, hundreds of times slower.
    """
    if abs(m.a - 1.0) < 1e-9:
        raise ValueError("the expectation is singular at a = 1")
    # Plain numbers, so that workers need no copy of this library to unpickle the function.
    alpha, abx = float(m.alpha), float(m.a + m.b - 1.0)
    first, second = float(m.a + m.b - 1.0 - m.r), float(m.a - 1.0)
    smallest = 1e-18 * min(1.0, abs(second))

    @F.pandas_udf("double")
    def expectation(x: pd.Series, age: pd.Series) -> pd.Series:
        c = (abx + x).to_numpy(dtype=float)
        elapsed = (alpha + age).to_numpy(dtype=float)
        out = np.zeros(len(c))
        for horizon, weight in horizons.items():
            z = horizon / (elapsed + horizon)
            term, total, k = np.ones(len(c)), np.ones(len(c)), 0
            while np.any(np.abs(term) > smallest * np.abs(total)):
                term = term * ((first + k) * (second + k) / (k + 1.0)) / (c + k) * z
                total = total + term
                k += 1
            out += weight * c / second * (1.0 - (1.0 - z) ** second * total)
        return pd.Series(out)

    return expectation


def expected_purchases(x: Column, t_x: Column, T: Column, m: BGNBDParams, horizon: float) -> Column:
    """Purchases expected in the next ``horizon`` time units, given the history."""
    return _expectation(m, {float(horizon): 1.0})(x, T) / (1.0 + _dropout_odds(x, t_x, T, m))


def expected_profit(x: Column, monetary: Column, g: GammaGammaParams) -> Column:
    """Expected mean value of a purchase, shrunk towards the population mean.

    Null where the model gives no weight at all (``p*x + q = 1``).
    """
    weight = F.try_divide(g.p * x, g.p * x + (g.q - 1.0))
    population = F.try_divide(F.lit(g.v * g.p), F.lit(g.q - 1.0))
    return (1.0 - weight) * population + weight * monetary


def lifetime_value(
    x: Column,
    t_x: Column,
    T: Column,
    monetary: Column,
    m: BGNBDParams,
    g: GammaGammaParams,
    months: int = CLV_MONTHS,
    discount_rate: float = CLV_DISCOUNT_RATE,
) -> Column:
    """Discounted value of the purchases expected in the next months, never below zero.

    Purchases of month i are E(i) - E(i-1), discounted by (1+rate)^i. Summed by parts,
    each E(i) is needed once, with the difference of two neighbouring discounts.
    """
    discount = [(1.0 + discount_rate) ** -i for i in range(1, months + 1)] + [0.0]
    weights = {WEEKS_PER_MONTH * i: discount[i - 1] - discount[i] for i in range(1, months + 1)}
    purchases = _expectation(m, weights)(x, T) / (1.0 + _dropout_odds(x, t_x, T, m))
    return at_least_zero(expected_profit(x, monetary, g) * purchases)
