import datetime as dt

import pytest

from retenta.operators.features import rfm_features
from retenta.operators.orders import order_revenue
from retenta.sources import warehouse
from retenta.sources.retail import catalog_tables, raw_tables
from retenta.sources.schemas import RAW_SCHEMAS


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("csv")
    (folder / "orders.csv").write_text(
        '"order_id","customer_id","order_status","order_purchase_timestamp","order_approved_at",'
        '"order_delivered_carrier_date","order_delivered_customer_date","order_estimated_delivery_date"\n'
        "o1,c1,delivered,2017-10-02 10:56:33,2017-10-02 11:07:15,2017-10-04 19:55:00,,2017-10-18 00:00:00\n"
    )
    (folder / "reviews.csv").write_text(
        '"review_id","order_id","review_score","review_comment_title","review_comment_message",'
        '"review_creation_date","review_answer_timestamp"\n'
        'r1,o1,4,,"two lines,\nand a ""quote""",2018-01-18 00:00:00,2018-01-18 21:46:59\n'
        "r2,o1,5,,,2018-01-18 00:00:00,2018-01-18 21:46:59\n"
    )
    (folder / "payments.csv").write_text(
        "order_id,payment_sequential,payment_type,payment_installments,payment_value\no1,1,boleto,1,10.5\no1,2,voucher,1,2.25\n"
    )
    (folder / "customers.csv").write_text(
        "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\nc1,p1,01409,x,SP\n"
    )
    files = {"orders": "orders", "order_reviews": "reviews", "order_payments": "payments", "customers": "customers", "sellers": "none"}
    spark.sql("CREATE DATABASE IF NOT EXISTS csv_test")
    report = warehouse.create_warehouse(
        spark, {k: f"{folder}/{v}.csv" for k, v in files.items()}, database="csv_test", order_buckets=4
    )
    return {r["table_name"]: (r["status"], r["row_count"]) for r in report.collect()}


def test_report_names_the_missing_file(loaded):
    assert loaded == {
        "raw_orders": ("loaded", 1),
        "raw_order_reviews": ("loaded", 2),
        "raw_order_payments": ("loaded", 2),
        "raw_customers": ("loaded", 1),
        "raw_sellers": ("missing", None),
    }


def test_types_and_quoting(spark, loaded):
    row = warehouse.load_table(spark, "raw_orders", "csv_test").first()
    assert row["order_purchase_timestamp"] == dt.datetime(2017, 10, 2, 10, 56, 33)
    assert row["order_delivered_customer_date"] is None
    reviews = {r["review_id"]: r["review_comment_message"] for r in warehouse.load_table(spark, "raw_order_reviews", "csv_test").collect()}
    assert reviews == {"r1": 'two lines,\nand a "quote"', "r2": None}
    assert warehouse.load_table(spark, "raw_customers", "csv_test").first()["customer_zip_code_prefix"] == "01409"


def test_loading_again_replaces(spark, loaded, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\nc1,p1,1,x,SP\n")
    for _ in range(2):
        report = warehouse.create_warehouse(spark, {"customers": str(path)}, database="csv_test")
        assert report.first()["row_count"] == 1


def test_features_from_the_catalog(spark, loaded):
    t = catalog_tables(spark, "csv_test")
    row = rfm_features(t.orders, t.customers, t.order_payments).first()
    assert (row["customer_unique_id"], row["monetary_value"], row["frequency"]) == ("p1", 12.75, 1)


def test_buckets_spare_the_shuffle(spark, loaded):
    payments = warehouse.load_table(spark, "raw_order_payments", "csv_test")
    reviews = warehouse.load_table(spark, "raw_order_reviews", "csv_test")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = order_revenue(payments).join(reviews.groupBy("order_id").count(), "order_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.first()["order_revenue"] == 12.75
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan and "SortMergeJoin" in plan


def test_nine_raw_tables_follow_the_schemas(spark):
    tables = raw_tables(spark, "/root/testdata/sf0.001").as_dict()
    assert set(tables) == set(RAW_SCHEMAS)
    for name, table in tables.items():
        assert set(table.columns) == set(RAW_SCHEMAS[name].fieldNames()), name
