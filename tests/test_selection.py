"""Order statistics by counting against numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from retenta.operators.profile import correlations
from retenta.operators.selection import exact_quantiles

SHARES = [0.0, 0.1, 0.25, 0.5, 0.777, 1.0]


def test_quantiles_of_several_columns(spark):
    rng = np.random.default_rng(8)
    n = 3000
    columns = {
        "crowded": 0.5 + np.where(rng.random(n) < 0.4, 0, rng.normal(size=n) * 1e-15),
        "signs": rng.normal(size=n) * 10.0 ** rng.integers(-300, 300, n),
        "zeros": rng.choice([0.0, -0.0, 5e-324, -5e-324], n),
        "holes": np.where(rng.random(n) < 0.5, np.nan, rng.integers(0, 4, n)),
        "one": np.full(n, 7.0),
    }
    df = spark.createDataFrame(pd.DataFrame(columns)).repartition(5)
    found = exact_quantiles(df, list(columns), SHARES)
    for name, x in columns.items():
        x = x[~np.isnan(x)]
        low = [np.quantile(x, p, method="lower") for p in SHARES]
        high = [np.quantile(x, p, method="higher") for p in SHARES]
        at = [(len(x) - 1) * p % 1 for p in SHARES]
        assert found[name] == [a + (b - a) * f for a, b, f in zip(low, high, at)], name


def test_infinite_and_missing_values(spark):
    df = spark.createDataFrame([(float("inf"), None), (float("-inf"), None), (1.0, None)], "a double, b double")
    assert exact_quantiles(df, ["a", "b"], [0.0, 0.5, 1.0]) == {"a": [float("-inf"), 1.0, float("inf")], "b": [None] * 3}
    assert exact_quantiles(df.limit(0), ["a"], [0.5]) == {"a": [None]}


def test_correlation_far_from_zero_without_a_row_per_pair(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 2))
    x[:, 1] += 0.5 * x[:, 0]
    far = x + 1e9
    df = spark.createDataFrame(pd.DataFrame(far, columns=["a", "b"])).repartition(6)
    got = {(r[0], r[1]): r[2] for r in correlations(df, ["a", "b"]).collect()}
    assert got["a", "b"] == pytest.approx(np.corrcoef(x.T)[0, 1], abs=1e-6)
    row = df.agg({"a": "count"})
    assert row.first()[0] == 4000
