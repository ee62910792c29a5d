import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from retenta.functions import clv
from retenta.functions.clv import BGNBDParams, GammaGammaParams
from retenta.operators import clv_fit, clv_predict
from retenta.operators.clv_fit import fit_bgnbd, fit_gamma_gamma

TRUE = BGNBDParams(0.8, 6.0, 0.9, 3.0)
SPEND = GammaGammaParams(6.0, 4.0, 15.0)


def simulate(n, seed, horizon=0.0):
    """Customers drawn from the model itself, with purchases in a later horizon."""
    rng = np.random.default_rng(seed)
    rate = rng.gamma(TRUE.r, 1 / TRUE.alpha, n)
    leave = rng.beta(TRUE.a, TRUE.b, n)
    age = rng.integers(20, 105, n).astype(float)
    x, last, later = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        now = 0.0
        while True:
            now += rng.exponential(1 / rate[i])
            if now > age[i] + horizon:
                break
            if now <= age[i]:
                x[i], last[i] = x[i] + 1, now
            else:
                later[i] += 1
            if rng.random() < leave[i]:
                break
    scale = rng.gamma(SPEND.q, 1 / SPEND.v, n)
    mean = [rng.gamma(SPEND.p * k, 1 / s) / k if k else 0.0 for k, s in zip(x, scale)]
    frame = pd.DataFrame(
        {
            "customer_unique_id": np.arange(n),
            "frequency": (x + 1).astype("int64"),
            "customer_lifespan_days": last * 7,
            "customer_age_days": age * 7,
            "monetary_value": mean,
        }
    )
    return frame, later


def direct_expectation(x, last, age, m, h):
    """The untransformed series, term by term, each from the one before."""
    A, B, C, z = m.r + x, m.b + x, m.a + m.b + x - 1, h / (m.alpha + age + h)
    term = total = 1.0
    for k in range(6000):
        term *= (A + k) * (B + k) / ((C + k) * (k + 1)) * z
        total += term
    top = C / (m.a - 1) * (1 - (1 - z) ** A * total)
    odds = m.a / (m.b + x - 1) * ((m.alpha + age) / (m.alpha + last)) ** (m.r + x) if x else 0.0
    return top / (1 + odds)


CASES = [(0.0, 0.0, 0.0), (0.0, 0.0, 80.0), (1.0, 3.0, 40.0), (4.0, 30.0, 31.0), (25.0, 90.0, 100.0)]


@pytest.mark.parametrize("m", [TRUE, BGNBDParams(2.0, 3.0, 1.7, 2.2), BGNBDParams(0.2, 1.5, 0.3, 0.6), BGNBDParams(0.5, 4.0, 6.0, 3.0)])
def test_expected_purchases_against_direct_series(spark, m):
    frame = spark.createDataFrame(CASES, "x double, last double, age double")
    for horizon in (1.0, 20.0, 52.0):
        column = clv.expected_purchases(F.col("x"), F.col("last"), F.col("age"), m, horizon)
        for row in frame.withColumn("e", column).collect():
            want = direct_expectation(row["x"], row["last"], row["age"], m, horizon)
            assert row["e"] == pytest.approx(want, rel=1e-7)


def test_expectation_is_singular_at_one():
    with pytest.raises(ValueError):
        clv.expected_purchases(F.lit(1.0), F.lit(1.0), F.lit(2.0), BGNBDParams(1.0, 1.0, 1.0, 1.0), 4.0)


def test_p_alive(spark):
    frame = spark.createDataFrame([*CASES, (50.0, 1.0, 5000.0)], "x double, last double, age double")
    column = clv.p_alive(F.col("x"), F.col("last"), F.col("age"), TRUE)
    rows = frame.withColumn("p", column).collect()
    for row in rows:
        x, last, age = row["x"], row["last"], row["age"]
        if x == 0:
            assert row["p"] == 1.0
        else:
            odds = TRUE.a / (TRUE.b + x - 1) * ((TRUE.alpha + age) / (TRUE.alpha + last)) ** (TRUE.r + x)
            assert row["p"] == pytest.approx(1 / (1 + odds))
    assert 0.0 <= rows[-1]["p"] < 1e-100


def test_lifetime_value_equals_monthly_sum(spark):
    g = GammaGammaParams(2.0, 3.5, 40.0)
    frame = spark.createDataFrame([(*c, 55.0) for c in CASES], "x double, last double, age double, m double")
    column = clv.lifetime_value(F.col("x"), F.col("last"), F.col("age"), F.col("m"), TRUE, g, months=5)
    for row in frame.withColumn("v", column).collect():
        x, last, age = row["x"], row["last"], row["age"]
        steps = [0.0] + [direct_expectation(x, last, age, TRUE, 4.345 * i) for i in range(1, 6)]
        weight = g.p * x / (g.p * x + g.q - 1)
        profit = (1 - weight) * g.v * g.p / (g.q - 1) + weight * row["m"]
        want = profit * sum((steps[i] - steps[i - 1]) / 1.01**i for i in range(1, 6))
        assert row["v"] == pytest.approx(want, rel=1e-7)


def test_negative_population_mean_is_clipped(spark):
    frame = spark.createDataFrame([(0.0, 0.0, 50.0, 10.0)], "x double, last double, age double, m double")
    g = GammaGammaParams(2.0, 0.5, 40.0)  # q below one
    columns = F.col("x"), F.col("last"), F.col("age"), F.col("m")
    assert frame.select(clv.expected_profit(F.col("x"), F.col("m"), g)).first()[0] < 0
    assert frame.select(clv.lifetime_value(*columns, TRUE, g)).first()[0] == 0.0


@pytest.fixture(scope="module")
def customers(spark):
    frame, later = simulate(8000, 1, horizon=26.0)
    return spark.createDataFrame(frame).repartition(6).cache(), later


def test_bgnbd_fit_recovers_parameters(customers):
    fitted = fit_bgnbd(customers[0], penalizer=0.0)
    assert fitted.r == pytest.approx(TRUE.r, rel=0.1)
    assert fitted.alpha == pytest.approx(TRUE.alpha, rel=0.15)
    assert fitted.a / (fitted.a + fitted.b) == pytest.approx(TRUE.a / (TRUE.a + TRUE.b), rel=0.1)


def test_penalty_shrinks_parameters(customers):
    free, bound = fit_bgnbd(customers[0], penalizer=0.0), fit_bgnbd(customers[0], penalizer=0.05)
    assert bound.a**2 + bound.b**2 < free.a**2 + free.b**2


def test_gamma_gamma_fit_recovers_parameters(customers):
    fitted = fit_gamma_gamma(customers[0], penalizer=0.0)
    assert fitted.p == pytest.approx(SPEND.p, rel=0.15)
    assert fitted.q == pytest.approx(SPEND.q, rel=0.1)
    assert fitted.v == pytest.approx(SPEND.v, rel=0.15)


def test_expectation_matches_later_purchases(customers):
    frame, later = customers
    total = clv_predict.expected_purchases(frame, TRUE, 26.0).agg(F.sum("expected_purchases")).first()[0]
    assert total == pytest.approx(later.sum(), rel=0.06)


def test_fit_needs_customers(customers):
    empty = customers[0].limit(0)
    with pytest.raises(ValueError):
        fit_bgnbd(empty)
    with pytest.raises(ValueError):
        fit_gamma_gamma(empty)


def test_a_heavy_buyer_who_left_is_not_cut(spark):
    """Log-odds of 969: the value agrees with a computation in logarithms."""
    r, alpha, a, b, x, last, age = row = (1.0, 0.05, 1.0, 2.0, 500.0, 0.1, 1.0)
    frame = spark.createDataFrame([row], "r double, alpha double, a double, b double, x double, last double, age double")
    steps, terms = clv_fit._bgnbd_per_row()
    for step in steps:
        frame = frame.withColumns(step)
    value, alive, gone = frame.select(terms["value"], "alive", "gone").first()
    log_odds = math.log(a / (b + x - 1)) + (r + x) * math.log((alpha + age) / (alpha + last))
    plain = math.lgamma(r + x) + math.lgamma(b + x) - math.lgamma(a + b + x) - (r + x) * math.log(alpha + age)
    assert log_odds > 900 and value == pytest.approx(plain + log_odds, rel=1e-12)
    assert gone == 1.0 and alive < 1e-300


def test_repeat_buyers_without_spend_are_an_error(customers):
    frame, _ = customers
    broken = frame.withColumn("monetary_value", F.when(F.col("frequency") > 2, 0.0).otherwise(F.col("monetary_value")))
    with pytest.raises(ValueError, match="repeat customers have no positive spend"):
        fit_gamma_gamma(broken)


def test_workers_need_no_copy_of_the_library(tmp_path):
    """Started from another folder, with the library on the driver's path only."""
    import os
    import subprocess
    import sys

    program = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import functions as F
from retenta.functions.clv import BGNBDParams, expected_purchases
from retenta.session import build_session
spark = build_session("apart", "local[2]", spark__ui__enabled="false")
x, last, age = (F.col("id").cast("double") * k for k in (1, 2, 3))
made = spark.range(1, 9).select(expected_purchases(x, last, age, BGNBDParams(0.9, 6.0, 0.7, 2.5), 10.0).alias("e"))
print("sum", made.agg(F.sum("e")).first()[0] > 0)
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", program, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "sum True" in done.stdout, done.stderr[-2000:]
