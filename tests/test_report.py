import datetime as dt
import math

import pytest

from retenta.operators import quality, report


@pytest.fixture(scope="module")
def predictions(spark):
    rows = [("a", 0.9, "High", 100.0), ("b", 0.8, "High", 0.0), ("c", 0.1, "Low", 50.0), ("d", 0.2, "Low", 10.0)]
    return spark.createDataFrame(rows, "customer_unique_id string, churn_proba double, churn_risk_tier string, predicted_clv double")


def test_kpis(predictions):
    row = report.kpi_cards(predictions).first()
    assert (row["total_customers"], row["high_risk_count"], row["revenue_at_risk"]) == (4, 2, 100.0)
    assert row["avg_churn_proba"] == pytest.approx(0.5)


def test_missing_tier_is_kept(predictions):
    assert [tuple(r) for r in report.tier_counts(predictions).collect()] == [("Low", 2), ("Medium", None), ("High", 2)]
    rows = [tuple(r) for r in report.clv_by_tier(predictions).collect()]
    assert rows == [("Low", 30.0, 60.0, 2), ("Medium", None, None, None), ("High", 100.0, 100.0, 1)]


def test_nan_is_left_out(spark, predictions):
    odd = spark.createDataFrame([("n", math.nan, "nan", math.nan)], predictions.schema).unionByName(predictions)
    assert report.kpi_cards(odd).first()["avg_churn_proba"] == pytest.approx(0.5)
    assert [r["n_customers"] for r in report.clv_by_tier(odd).collect()] == [2, None, 1]
    assert tuple(report.clv_bounds(odd).first()) == (0.0, 100.0)
    assert report.clv_histogram(odd).agg({"n": "sum"}).first()[0] == 3
    assert [r[0] for r in report.customer_detail(odd).collect()] == ["a", "b", "d", "c", "n"]


def test_filters_are_inclusive(predictions):
    assert report.filter_predictions(predictions).count() == 4
    assert report.filter_predictions(predictions, "Low").count() == 2
    assert report.filter_predictions(predictions, "All", (10.0, 50.0)).count() == 2


def test_detail_order(predictions):
    assert [r[0] for r in report.customer_detail(predictions).collect()] == ["a", "b", "d", "c"]


def test_quadrants(predictions):
    got = {r["customer_unique_id"]: (r["quadrant"], r["median_clv"]) for r in report.clv_quadrants(predictions).collect()}
    assert got == {"a": ("Danger — High Value", 50.0), "c": ("Safe — High Value", 50.0), "d": ("Safe — Low Value", 50.0)}


def test_clv_bounds(predictions):
    assert tuple(report.clv_bounds(predictions).first()) == (0.0, 100.0)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.49,), (0.5,), (1.0,), (None,)], "v double")
    rows = {r["bin"]: (r["bin_start"], r["n"]) for r in report.histogram(df, "v", 2).collect()}
    assert rows == {0: (0.0, 2), 1: (0.5, 2)}  # the largest value belongs to the last bin
    same = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert [tuple(r) for r in report.histogram(same, "v", 5).collect()] == [(0, 3.0, 2)]


def test_month_without_orders_is_zero(spark):
    rows = [(dt.datetime(2018, 1, 31, 23),), (dt.datetime(2018, 1, 1),), (dt.datetime(2018, 4, 15),), (None,)]
    got = report.monthly_orders(spark.createDataFrame(rows, "order_purchase_timestamp timestamp_ntz")).collect()
    assert [(r["month_end"].isoformat(), r["order_count"]) for r in got] == [
        ("2018-01-31", 2), ("2018-02-28", 0), ("2018-03-31", 0), ("2018-04-30", 1)
    ]


def test_purchase_distribution(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 1), ("c", 10), ("d", 25), ("e", 2)], "customer_unique_id string, n_purchases bigint")
    rows = [tuple(r) for r in report.purchase_distribution(counts).collect()]
    assert rows == [(1, 2, "1"), (2, 1, "2"), (10, 2, "10+")]
    assert tuple(report.repeat_share(counts).first()) == (2, 0.4, 3, 0.6)


def test_quality_reports(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, None), (None, 4), ("b", 5)], "k string, v int")
    checks = {"t": (["k", "v"], ["k"])}
    nulls = {r["column_name"]: r["failures"] for r in quality.not_null_report({"t": df}, checks).collect()}
    assert nulls == {"k": 2, "v": 1}
    assert [r["failures"] for r in quality.unique_report({"t": df}, checks).collect()] == [1]
    assert quality.null_rows(df, "k").count() == 2
    assert [tuple(r) for r in quality.duplicated_keys(df, "k").collect()] == [("a", 2)]


def test_number_of_declared_checks():
    groups = (quality.RAW_CHECKS, quality.STAGING_CHECKS, quality.MART_CHECKS)
    assert [sum(len(n) + len(u) for n, u in g.values()) for g in groups] == [11, 18, 19]


def test_values_outside_of_all_bins_stop_the_job(spark):
    for values, span in (([0.5, 1.5], (0.0, 1.0)), ([1.0, float("inf")], None)):
        frame = spark.createDataFrame([(v,) for v in values], "v double")
        with pytest.raises(Exception, match="outside of all bins"):
            report.histogram(frame, "v", 4, value_range=span).collect()
