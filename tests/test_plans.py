"""What the executed plans look like: scans, reuse, pushdown, skew, broadcasts."""

import re

import pytest

from pyspark.sql.classic.dataframe import DataFrame

from retenta.operators import features, prefix_sums, profile
from retenta.plans import catalog
from retenta.sources.retail import raw_tables

SF = "/root/testdata/sf0.001"


def executed(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


def scans(plan, table):
    return len(re.findall(rf"FileScan parquet [^\n]*{table}\.parquet", plan))


def raw(t):
    return t.orders, t.customers, t.order_payments, t.order_items, t.order_reviews, t.products


def test_rfm_reads_each_table_once(spark):
    t = raw_tables(spark, SF, delivery_dates=False)
    plan = executed(features.rfm_features(t.orders, t.customers, t.order_payments))
    assert [scans(plan, name) for name in ("orders", "customer", "lineitem")] == [1, 1, 1]
    assert "ReusedExchange" in plan  # the snapshot comes from the same shuffle


@pytest.mark.parametrize("build", [features.behavioral_features, features.churn_dataset])
def test_behavior_reads_each_logical_table_once(spark, build):
    t = raw_tables(spark, SF, delivery_dates=False)
    args = ("1999-01-01", 365) if build is features.churn_dataset else ()
    plan = executed(build(*raw(t), *args))
    # payments, items and reviews all come from one source table
    assert [scans(plan, name) for name in ("orders", "customer", "lineitem", "part")] == [1, 1, 3, 1]
    assert "CartesianProduct" not in plan and "Expand" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    t = raw_tables(spark, SF, delivery_dates=False)
    plan = executed(features.active_after_cutoff(t.orders, t.customers, t.order_payments, t.order_items, "1999-01-01", 365))
    orders_scan = next(line for line in plan.splitlines() if "FileScan" in line and "orders.parquet" in line)
    text = t.orders.sparkSession.read.parquet(f"{SF}/orders.parquet")
    assert "o_totalprice" in text.columns and "o_totalprice" not in orders_scan
    assert "GreaterThanOrEqual(o_orderdate" in orders_scan and "LessThan(o_orderdate" in orders_scan


def test_summaries_shuffle_no_values(spark, monkeypatch):
    """Quartiles and moments come from one written table of columns, by aggregates over whole rows."""
    plans = []
    collect, first = DataFrame.toArrow, DataFrame.first
    monkeypatch.setattr(DataFrame, "toArrow", lambda df: plans.append(executed(df)) or collect(df))
    monkeypatch.setattr(DataFrame, "first", lambda df: plans.append(executed(df)) or first(df))
    df = spark.range(1000).selectExpr("id % 7 AS a", "id * 0.5 AS b")
    profile.describe(df, ["a", "b"]).collect()
    profile.correlations(df, ["a", "b"]).collect()
    assert len(plans) == 6 and not any("Generate" in plan or "Sort " in plan for plan in plans)


@pytest.mark.parametrize("name", ["roc_auc", "roc_curve", "average_precision"])
def test_curves_compute_their_input_once(spark, name, monkeypatch):
    plans = []
    write = prefix_sums.stage
    monkeypatch.setattr(prefix_sums, "stage", lambda df, label: plans.append(executed(df)) or write(df, label))
    rest = executed(catalog.queries()[name](spark, SF))
    assert [scans(plan, "orders") for plan in plans] == [1] and scans(rest, "orders") == 0
    assert "rangepartitioning(score" in plans[0] and "Window" not in plans[0] + rest


@pytest.mark.parametrize("name", ["kpi_cards", "mart_clv_features", "churn_label_window"])
def test_reports_compute_their_input_once(spark, name):
    plan = executed(catalog.queries()[name](spark, SF))
    # The marts read payments, reviews and shipping dates from the same source table.
    assert scans(plan, "orders") == 1 and scans(plan, "lineitem") == (3 if name.startswith("mart") else 1)


def test_skewed_product_is_split(spark):
    """With no broadcast, a product holding a third of the items is read in several tasks."""
    n = 120_000
    items = spark.range(n).selectExpr(
        "concat('o', id % 30000) AS order_id",
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('i', id % 5000) END AS product_id",
        "1.5D AS freight_value",
    )
    products = spark.range(5000).selectExpr("concat('i', id) AS product_id", "concat('cat', id % 9) AS product_category_name")
    products = products.unionByName(spark.sql("SELECT 'hot' AS product_id, 'hot' AS product_category_name"))
    orders = spark.range(30000).selectExpr(
        "concat('o', id) AS order_id", "concat('c', id % 900) AS customer_id", "'delivered' AS order_status",
        "TIMESTAMP_NTZ'2018-01-01 00:00:00' AS order_purchase_timestamp",
        "CAST(NULL AS TIMESTAMP_NTZ) AS order_delivered_customer_date",
        "TIMESTAMP_NTZ'2018-01-05 00:00:00' AS order_estimated_delivery_date",
    )
    customers = spark.range(900).selectExpr("concat('c', id) AS customer_id", "concat('p', id) AS customer_unique_id")
    payments = spark.range(30000).selectExpr("concat('o', id) AS order_id", "1 AS payment_installments", "2.0D AS payment_value")
    reviews = spark.range(0).selectExpr("concat('o', id) AS order_id", "1 AS review_score")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.shuffle.partitions": "16",
    }
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df = features.behavioral_features(orders, customers, payments, items, reviews, products)
        plan = executed(df)
        totals = df.selectExpr("count(*)", "sum(frequency)", "max(n_distinct_categories)").first()
    finally:
        for key in settings:
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert "skew=true" in plan
    assert tuple(totals)[:2] == (900, 30000)
