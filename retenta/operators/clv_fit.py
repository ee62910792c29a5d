"""Maximum-likelihood fits of the lifetime-value models, one Spark aggregate per step.

The driver holds three or four parameters; likelihood, gradient and Hessian are sums of
column expressions over the customers. For the BG/NBD model, customers with equal
histories are merged first: it sees only whole days and counts, so the merged table
stays small however many customers there are.
"""

from __future__ import annotations

import math
from itertools import combinations_with_replacement
from typing import Callable, NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retenta.config import PENALIZER
from retenta.functions.clv import BGNBDParams, GammaGammaParams
from retenta.functions.special import digamma, lgamma, ln, trigamma
from retenta.operators.features import bgnbd_inputs
from retenta.session import staged


class NotConverged(RuntimeError):
    pass


class Certificate(NamedTuple):
    """What shows that parameters are an optimum: the objective there, its largest slope, and the least pivot of
    its Hessian (positive where it bends upwards in every direction), all in the logarithms of the parameters."""

    objective: float
    gradient_norm: float
    least_pivot: float
    n_customers: int


def least_pivot(hessian: np.ndarray) -> float:
    """Least pivot of the elimination without exchanges, from the first parameter on."""
    rest, least = hessian.astype(float).copy(), math.inf
    while len(rest):
        least = min(least, rest[0, 0])
        if rest[0, 0] == 0:
            break
        rest = rest[1:, 1:] - np.outer(rest[1:, 0], rest[0, 1:]) / rest[0, 0]
    return float(least)


Key = str | int | tuple[int, int]


class Model(NamedTuple):
    """A log-likelihood split in a part per row and a part of the parameters only.

    ``per_row`` gives columns over the rows and the parameter columns: steps of named
    intermediate values, each built on the ones before, and the terms. ``constant``
    gives floats that count once per customer. Terms are keyed 'value', i for the
    gradient and (i, j) for the upper Hessian; a missing key is zero.
    """

    params: tuple[str, ...]
    per_row: Callable[[], tuple[list[dict[str, Column]], dict[Key, Column]]]
    constant: Callable[..., dict[Key, float]]


def _maximise(
    rows: DataFrame,
    model: Model,
    weight: float,
    penalizer: float,
    tolerance: float = 1e-7,
    max_steps: int = 200,
) -> tuple[np.ndarray, Certificate]:
    """Newton steps on the logarithms of the parameters, damped until the value falls.

    Minimises the mean negative log-likelihood plus ``penalizer`` times the sum of the
    squared parameters. The parameters reach the rows as a one-row table and not as
    literals, so that every step runs the code generated for the first one.
    """
    size = len(model.params)
    steps, terms = model.per_row()
    slots = list(combinations_with_replacement(range(size), 2))
    names = ["value", *range(size), *slots]
    labels = {name: f"s{k}" for k, name in enumerate(names)}
    sums = [F.sum(F.col("n") * term).alias(labels[name]) for name, term in terms.items()]

    def evaluate(theta: np.ndarray):
        params = np.exp(theta)
        listed = ", ".join(f"{float(value)!r}D" for value in params)
        one_row = rows.sparkSession.sql(f"SELECT * FROM VALUES ({listed}) AS t({', '.join(model.params)})")
        frame = rows.crossJoin(F.broadcast(one_row))
        for step in steps:
            frame = frame.withColumns(step)
        found = frame.agg(*sums).first().asDict()
        constant = model.constant(*map(float, params))

        def mean(name) -> float:
            return found.get(labels[name], 0.0) / weight + constant.get(name, 0.0)

        gradient = np.array([mean(i) for i in range(size)])
        hessian = np.zeros((size, size))
        for i, j in slots:
            hessian[i, j] = hessian[j, i] = mean((i, j))
        value = -mean("value") + penalizer * np.sum(params**2)
        slope = -params * gradient + 2 * penalizer * params**2
        curvature = -(np.outer(params, params) * hessian + np.diag(params * gradient))
        curvature += np.diag(4 * penalizer * params**2)
        return value, slope, curvature

    theta = np.zeros(size)
    value, slope, curvature = evaluate(theta)
    for _ in range(max_steps):
        norm = float(np.max(np.abs(slope)))
        if norm < tolerance:
            return np.exp(theta), Certificate(float(value), norm, least_pivot(curvature), int(weight))
        # Flip and floor the eigenvalues: a downhill direction, also far from the optimum.
        lengths, axes = np.linalg.eigh(curvature)
        step = -axes @ ((axes.T @ slope) / np.maximum(np.abs(lengths), 1e-8))
        step *= min(1.0, 2.0 / np.max(np.abs(step)))
        scale = 1.0
        while True:
            trial = evaluate(theta + scale * step)
            if np.isfinite(trial[0]) and trial[0] <= value + 1e-4 * scale * float(slope @ step) + 1e-13:
                break
            scale /= 2
            if scale < 1e-8:
                raise NotConverged(f"no step lowers the objective, gradient {np.max(np.abs(slope)):.2e}")
        theta = theta + scale * step
        value, slope, curvature = trial
    raise NotConverged(f"gradient still {np.max(np.abs(slope)):.2e} after {max_steps} steps")


def _bgnbd_per_row() -> tuple[list[dict[str, Column]], dict[Key, Column]]:
    r, alpha, a, b = (F.col(name) for name in BGNBDParams._fields)
    x, last, age = F.col("x"), F.col("last"), F.col("age")
    basics = {
        "purchases": r + x,
        "bx": b + x,
        "abx": a + b + x,
        "before_last": b + F.greatest(x, F.lit(1.0)) - 1.0,
        "log_age": ln(alpha + age),
        "log_last": ln(alpha + last),
        "inv_age": 1.0 / (alpha + age),
        "inv_last": 1.0 / (alpha + last),
    }
    purchases, bx, abx, before_last, log_age, log_last, inv_age, inv_last = map(F.col, basics)
    # Two ways to see no purchase since: still alive, or gone right after the last one.
    log_odds_gone = ln(a) - ln(before_last) + purchases * (log_age - log_last)
    specials = {
        # The smaller of odds and inverse odds never overflows; both chances follow from it.
        "log_odds": F.when(x > 0, log_odds_gone).otherwise(F.lit(float("-inf"))),
        "psi_abx": digamma(abx),
        "psi1_abx": trigamma(abx),
    }
    log_odds, psi_abx, psi1_abx = map(F.col, specials)
    minor = F.exp(-F.abs(log_odds))
    likely, unlikely = 1.0 / (1.0 + minor), minor / (1.0 + minor)
    chances = {
        "alive": F.when(log_odds > 0, unlikely).otherwise(likely),
        "gone": F.when(log_odds > 0, likely).otherwise(unlikely),
        "log_either": F.greatest(log_odds, F.lit(0.0)) + F.log1p(minor),
    }
    alive, gone, log_either = map(F.col, chances)
    rate = alive * inv_age + gone * inv_last
    terms: dict[Key, Column] = {
        "value": lgamma(purchases) + lgamma(bx) - lgamma(abx) - purchases * log_age + log_either,
        0: digamma(purchases) - (alive * log_age + gone * log_last),
        1: -purchases * rate,
        2: gone / a - psi_abx,
        3: digamma(bx) - psi_abx - gone / before_last,
        (0, 0): trigamma(purchases),
        (0, 1): -rate,
        (1, 1): purchases * (alive * inv_age * inv_age + gone * inv_last * inv_last),
        (2, 2): -psi1_abx - gone / (a * a),
        (2, 3): -psi1_abx,
        (3, 3): trigamma(bx) - psi1_abx + gone / (before_last * before_last),
    }
    # The log of a sum bends by the spread between the gradients of its two branches.
    spread = [log_age - log_last, purchases * (inv_age - inv_last), 1.0 / a, -1.0 / before_last]
    for i, j in combinations_with_replacement(range(4), 2):
        bend = alive * gone * spread[i] * spread[j]
        terms[i, j] = terms[i, j] + bend if (i, j) in terms else bend
    return [basics, specials, chances], terms


def _bgnbd_constant(r: float, alpha: float, a: float, b: float) -> dict[Key, float]:
    both = trigamma(a + b)
    return {
        "value": lgamma(a + b) - lgamma(r) - lgamma(b) + r * math.log(alpha),
        0: math.log(alpha) - digamma(r),
        1: r / alpha,
        2: digamma(a + b),
        3: digamma(a + b) - digamma(b),
        (0, 0): -trigamma(r),
        (0, 1): 1.0 / alpha,
        (1, 1): -r / alpha**2,
        (2, 2): both,
        (2, 3): both,
        (3, 3): both - trigamma(b),
    }


BGNBD = Model(BGNBDParams._fields, _bgnbd_per_row, _bgnbd_constant)


def merged_histories(features: DataFrame) -> DataFrame:
    """Customers with the same (x, t, T) as one row of weight ``n``, all in double."""
    inputs = bgnbd_inputs(features)
    return inputs.groupBy(
        F.col("repeat_purchases").cast("double").alias("x"),
        F.col("recency_weeks").alias("last"),
        F.col("age_weeks").alias("age"),
    ).agg(F.count("*").cast("double").alias("n"))


def fit_bgnbd(features: DataFrame, penalizer: float = PENALIZER) -> BGNBDParams:
    """Fit (r, alpha, a, b) in weeks."""
    return certified_bgnbd(features, penalizer)[0]


def certified_bgnbd(features: DataFrame, penalizer: float = PENALIZER) -> tuple[BGNBDParams, Certificate]:
    """The fit with its certificate.

    Time is scaled to a longest age of one while fitting, which is where the penalty
    applies, and ``alpha`` is scaled back.
    """
    with staged(merged_histories(features), "histories") as histories:
        size = histories.agg(F.sum("n").alias("n"), F.max("age").alias("longest")).first()
        if not size["n"]:
            raise ValueError("no customers to fit")
        longest = size["longest"] or 1.0
        scaled = histories.withColumns({"last": F.col("last") / longest, "age": F.col("age") / longest}).persist()
        try:
            (r, alpha, a, b), certificate = _maximise(scaled, BGNBD, size["n"], penalizer)
        finally:
            scaled.unpersist()
    return BGNBDParams(float(r), float(alpha * longest), float(a), float(b)), certificate


def _gamma_gamma_per_row() -> tuple[list[dict[str, Column]], dict[Key, Column]]:
    p, q, v = (F.col(name) for name in GammaGammaParams._fields)
    x, m = F.col("x"), F.col("m")
    basics = {"shape": p * x, "shape_q": p * x + q, "spend": x * m + v}
    shape, shape_q, spend = map(F.col, basics)
    specials = {"log_spend": ln(spend), "psi_q": digamma(shape_q), "psi1_q": trigamma(shape_q)}
    log_spend, psi_q, psi1_q = map(F.col, specials)
    terms: dict[Key, Column] = {
        "value": lgamma(shape_q) - lgamma(shape) + (shape - 1.0) * ln(m) + shape * ln(x) - shape_q * log_spend,
        0: x * (psi_q - digamma(shape) + ln(m) + ln(x) - log_spend),
        1: psi_q - log_spend,
        2: -shape_q / spend,
        (0, 0): x * x * (psi1_q - trigamma(shape)),
        (0, 1): x * psi1_q,
        (0, 2): -x / spend,
        (1, 1): psi1_q,
        (1, 2): -1.0 / spend,
        (2, 2): shape_q / (spend * spend),
    }
    return [basics, specials], terms


def _gamma_gamma_constant(p: float, q: float, v: float) -> dict[Key, float]:
    return {
        "value": q * math.log(v) - lgamma(q),
        1: math.log(v) - digamma(q),
        2: q / v,
        (1, 1): -trigamma(q),
        (1, 2): 1.0 / v,
        (2, 2): -q / v**2,
    }


GAMMA_GAMMA = Model(GammaGammaParams._fields, _gamma_gamma_per_row, _gamma_gamma_constant)


def fit_gamma_gamma(features: DataFrame, penalizer: float = PENALIZER) -> GammaGammaParams:
    """Fit (p, q, v) on persons with more than one purchase, on their total spend."""
    return certified_gamma_gamma(features, penalizer)[0]


def certified_gamma_gamma(features: DataFrame, penalizer: float = PENALIZER) -> tuple[GammaGammaParams, Certificate]:
    """The fit with its certificate.

    The model knows positive spend only; repeat buyers without one are an error in the data.
    """
    repeat = bgnbd_inputs(features.filter(F.col("frequency") > 1))
    rows = repeat.select(
        F.col("repeat_purchases").cast("double").alias("x"),
        F.col("monetary_value").alias("m"),
        F.lit(1.0).alias("n"),
    )
    with staged(rows, "spend") as written:
        cached = written.persist()
        try:
            unfit = F.count(F.when(~F.coalesce(F.col("m") > 0, F.lit(False)) | F.isnan("m"), 1))
            weight, n_unfit = cached.agg(F.sum("n"), unfit).first()
            if n_unfit:
                raise ValueError(f"{n_unfit} repeat customers have no positive spend")
            if not weight:
                raise ValueError("no repeat customers to fit")
            (p, q, v), certificate = _maximise(cached, GAMMA_GAMMA, weight, penalizer)
        finally:
            cached.unpersist()
    return GammaGammaParams(float(p), float(q), float(v)), certificate
