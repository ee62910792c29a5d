"""Features against a plain pandas join that builds the whole fan-out."""

import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from retenta.config import FEATURE_COLS
from retenta.functions.clv import BGNBDParams
from retenta.operators import features, marts, orders
from retenta.operators.staging import stg_customers, stg_order_payments, stg_order_reviews, stg_orders
from retenta.session import stage
from retenta.sources.schemas import RAW_SCHEMAS


def frames(rows):
    return {name: pd.DataFrame(rows[name], columns=RAW_SCHEMAS[name].fieldNames()) for name in rows}


def joined(rows, inner_items):
    t = frames(rows)
    out = t["orders"][t["orders"].order_status == "delivered"].merge(t["customers"], on="customer_id")
    out = out.merge(t["order_payments"], on="order_id")
    out = out.merge(t["order_items"], on="order_id", how="inner" if inner_items else "left")
    out = out.merge(t["order_reviews"], on="order_id", how="left")
    products = t["products"][["product_id", "product_category_name"]]
    out = out.merge(products, on="product_id", how="left")
    out["day"] = out.order_purchase_timestamp.dt.normalize()
    arrived = out.order_delivered_customer_date.fillna(out.order_estimated_delivery_date).dt.normalize()
    days = (arrived - out.day).dt.days
    out["days"] = days.where(days >= 0)
    return out


def expected_behavior(rows_of_person):
    g = rows_of_person
    return {
        "frequency": g.order_id.nunique(),
        "monetary_value": g.payment_value.sum(),
        "avg_order_value": g.payment_value.mean(),
        "avg_review_score": g.review_score.mean(),
        "avg_delivery_days": g.days.mean(),
        "n_distinct_categories": g.product_category_name.nunique(),
        "avg_freight_value": g.freight_value.mean(),
        "used_installments": int((g.payment_installments > 1).any()),
        "first_purchase_date": g.day.min().date(),
        "last_purchase_date": g.day.max().date(),
    }


def assert_same(row, expected):
    for name, value in expected.items():
        if isinstance(value, float) and math.isnan(value):
            assert row[name] is None, name
        elif isinstance(value, float):
            assert row[name] == pytest.approx(value, rel=1e-12), name
        else:
            assert row[name] == value, name


def by_person(df):
    return {row["customer_unique_id"]: row.asDict() for row in df.collect()}


def raw(t):
    return t.orders, t.customers, t.order_payments, t.order_items, t.order_reviews, t.products


def test_rfm(edge_tables):
    t = edge_tables
    got = by_person(features.rfm_features(t.orders, t.customers, t.order_payments))
    assert set(got) == {"p1", "p2", "p3", "p4"}
    p1 = got["p1"]
    assert p1["frequency"] == 4  # o3 and o4 share a day
    assert p1["monetary_value"] == pytest.approx(10.25 + 20.5 + 35.75 + 7.0 + 11.11)
    assert p1["snapshot_date"] == dt.date(2018, 1, 30)
    assert (p1["recency_days"], p1["customer_age_days"], p1["customer_lifespan_days"]) == (5, 29, 24)
    assert got["p2"]["monetary_value"] == 100.0  # the order without payment drops out
    assert got["p3"]["customer_age_days"] == 0
    assert got["p4"]["monetary_value"] == 3.33


def test_snapshot_needs_a_known_customer_and_a_payment(edge_tables):
    t = edge_tables
    assert features.snapshot_date(t.orders, t.customers, t.order_payments).first()[0] == dt.date(2018, 1, 30)


def test_behavioral_equals_full_fanout(edge_tables, edge_rows):
    got = by_person(features.behavioral_features(*raw(edge_tables)))
    full = joined(edge_rows, inner_items=False)
    assert set(got) == set(full.customer_unique_id)
    for person, rows in full.groupby("customer_unique_id"):
        assert_same(got[person], expected_behavior(rows))
    assert got["p1"]["frequency"] == 5
    assert got["p1"]["monetary_value"] > 150  # o3 counts four times


def test_behavioral_with_hot_keys(spark):
    """One order, one product and one person hold a third of the rows each."""
    n = 600
    orders_rows = [(f"o{i}", f"c{i % 40 if i % 3 else 0}", "delivered", dt.datetime(2018, 1, 1 + i % 28), None, None,
                    dt.datetime(2018, 2, 1 + i % 20), None) for i in range(200)]
    hot = [i if i % 3 else 0 for i in range(n)]
    tables = {
        "orders": orders_rows,
        "customers": [(f"c{i}", f"p{i // 2}", "", "", "") for i in range(40)],
        "order_payments": [(f"o{hot[i] % 200}", i, "x", i % 4, i * 0.37) for i in range(n)],
        "order_items": [(f"o{i % 190}", i, f"i{hot[i] % 50}", "s", None, 1.0, i * 0.11) for i in range(n)],
        "order_reviews": [(f"r{i}", f"o{i % 170}", i % 5 + 1, None, None, None, None) for i in range(300)],
        "products": [(f"i{i}", f"cat{i % 7}", 1, 1, 1, 1, 1, 1, 1) for i in range(45)],
    }
    t = {name: spark.createDataFrame(rows, RAW_SCHEMAS[name]) for name, rows in tables.items()}
    for name in tables:
        tables[name] = [tuple(r) for r in tables[name]]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = by_person(
            features.behavioral_features(
                t["orders"], t["customers"], t["order_payments"], t["order_items"], t["order_reviews"], t["products"]
            )
        )
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    full = joined(tables, inner_items=False)
    assert set(got) == set(full.customer_unique_id)
    for person, rows in full.groupby("customer_unique_id"):
        assert_same(got[person], expected_behavior(rows))


def test_churn_dataset(edge_tables, edge_rows):
    got = by_person(features.churn_dataset(*raw(edge_tables), "2018-01-20", 10))
    full = joined(edge_rows, inner_items=True)
    observed = full[full.day < "2018-01-20"]
    assert set(got) == set(observed.customer_unique_id) == {"p1", "p4"}
    for person, rows in observed.groupby("customer_unique_id"):
        assert_same(got[person], expected_behavior(rows))
        assert got[person]["cutoff_date"] == dt.date(2018, 1, 20)
    assert got["p1"]["churned"] == 0  # o11 lies in the window
    assert got["p4"]["churned"] == 1


def test_window_is_half_open(edge_tables):
    t = edge_tables

    def active(days):
        out = features.active_after_cutoff(t.orders, t.customers, t.order_payments, t.order_items, "2018-01-25", days)
        return {row[0] for row in out.collect()}

    assert active(5) == {"p1"}  # the cutoff day is in, 30 January is out
    assert active(6) == {"p1", "p3"}


def test_order_metrics_do_not_fan_out(edge_tables):
    t = edge_tables
    got = by_person(
        orders.int_customer_orders(
            stg_orders(t.orders), stg_customers(t.customers), stg_order_payments(t.order_payments), stg_order_reviews(t.order_reviews)
        )
    )
    p1 = got["p1"]
    assert p1["total_orders"] == 5
    assert p1["total_revenue"] == pytest.approx(84.61)
    assert p1["avg_review_score"] == pytest.approx((5 + 2.5) / 2)  # mean of order means
    assert p1["avg_delivery_days"] == pytest.approx((1 - 1 + 22 + 22 + 7) / 5)  # negatives stay
    assert got["p2"]["total_orders"] == 2 and got["p2"]["total_revenue"] == 100.0  # unpaid counts as 0
    assert got["p4"]["avg_review_score"] is None


def test_clv_mart_drops_age_zero(edge_tables):
    t = edge_tables
    rfm = marts.mart_rfm_features(
        orders.int_customer_orders(
            stg_orders(t.orders), stg_customers(t.customers), stg_order_payments(t.order_payments), stg_order_reviews(t.order_reviews)
        )
    )
    got = by_person(marts.mart_clv_features(rfm))
    assert "p3" not in got
    assert got["p1"]["frequency"] == 4 and got["p1"]["monetary_value"] == pytest.approx(84.61 / 5)
    labels = by_person(marts.mart_churn_labels(rfm, inactivity_days=5))
    assert (labels["p1"]["churned"], labels["p3"]["churned"]) == (1, 0)


class TestChurnLabel:
    def test_follows_recency(self, sample_rfm):
        for row in features.add_churn_label(sample_rfm, 180).collect():
            assert row["churned"] == int(row["recency_days"] >= 180)

    def test_edges(self, spark):
        frame = spark.createDataFrame([(179,), (180,), (None,)], "recency_days int")
        assert [r["churned"] for r in features.add_churn_label(frame, 180).collect()] == [0, 1, 0]

    def test_longer_window_churns_no_more(self, sample_rfm):
        def churned(days):
            return features.add_churn_label(sample_rfm, days).agg(F.sum("churned")).first()[0]

        assert churned(30) >= churned(180) >= churned(365)

    def test_input_is_unchanged(self, sample_rfm):
        before = list(sample_rfm.columns)
        features.add_churn_label(sample_rfm)
        assert sample_rfm.columns == before


def test_feature_matrix_hides_what_defines_the_label(sample_rfm):
    matrix = features.feature_matrix(sample_rfm, BGNBDParams(0.8, 6.0, 0.9, 3.0))
    assert matrix.columns == ["customer_unique_id", *FEATURE_COLS, "churned"]
    assert {row[0] for row in matrix.select("churned").distinct().collect()} == {0, 1}


def test_single_purchase_is_never_churned_by_alive_label(spark):
    frame = spark.createDataFrame([("a", 1, 0, 700)], "customer_unique_id string, frequency bigint, customer_lifespan_days int, customer_age_days int")
    row = features.add_alive_label(frame, BGNBDParams(0.8, 6.0, 0.9, 3.0)).first()
    assert (row["p_alive"], row["churned"]) == (1.0, 0)


def test_repeated_order_rows_count_no_order_again(edge_tables):
    """Counts are of distinct orders; the rows of an order may come twice."""
    t = edge_tables

    def frequency(orders):
        made = features.behavioral_features(
            orders, t.customers, t.order_payments, t.order_items, t.order_reviews, t.products
        )
        return {r.customer_unique_id: r.frequency for r in made.collect()}

    assert frequency(t.orders.union(t.orders)) == frequency(t.orders)


def test_one_pass_gives_both_feature_sets(spark, edge_tables):
    """Also with order rows repeated on days before the cutoff and after the window, and without a day."""
    t = edge_tables
    orders, early = t.orders, t.orders.filter("order_purchase_timestamp < TIMESTAMP_NTZ'2018-01-20 00:00:00'")
    bought = "order_purchase_timestamp"
    for moved in (f"{bought} - INTERVAL 40 DAYS", f"{bought} + INTERVAL 40 DAYS", "CAST(NULL AS TIMESTAMP_NTZ)"):
        orders = orders.unionByName(early.withColumn(bought, F.expr(moved)))
    rest = raw(t)[1:]
    window = ("2018-01-20", 10)
    totals = stage(features.history_totals(orders, *rest, *window), "totals")
    for alone, shared in (
        (features.behavioral_features(orders, *rest), features.behavior_of_totals(totals)),
        (features.churn_dataset(orders, *rest, *window), features.churn_dataset_of_totals(totals, window[0])),
    ):
        assert alone.dtypes == shared.dtypes
        assert sorted(map(str, alone.collect())) == sorted(map(str, shared.collect())) != []


def test_person_totals_add_no_wide_decimals(edge_tables):
    """Their sums are of longs: adding decimals(38,0) was half of the time behind the basket rows."""
    plan = features.behavioral_features(*raw(edge_tables))._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(n_payments#" in plan
    assert not any(f"sum({name}#" in plan for name in ("payment_total", "freight_total"))
