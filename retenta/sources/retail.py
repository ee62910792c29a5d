"""The nine raw tables, derived from the retail star schema (orders, lineitem, ...).

Each function is a projection of the tables it reads; the only join is the optional
delivery date of an order, which is the last shipment among its finished lines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Schemas of the source tables.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
}
# End of fixed values.


RAW_NAMES = (
    "customers",
    "orders",
    "order_items",
    "order_payments",
    "order_reviews",
    "products",
    "sellers",
    "geolocation",
    "product_category_translation",
)


class RawTables:
    """The nine raw tables as attributes, each one built when it is first asked for."""

    def __init__(self, builders: dict[str, Callable[[], DataFrame]]) -> None:
        self._builders = builders

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._builders:
            raise AttributeError(name)
        table = self._builders[name]()
        setattr(self, name, table)
        return table

    def as_dict(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in self._builders}


def catalog_tables(spark: SparkSession, database: str = "default") -> RawTables:
    """The raw tables as loaded into the catalog by ``create_warehouse``."""
    return RawTables({name: partial(spark.table, f"{database}.raw_{name}") for name in RAW_NAMES})


def raw_tables(spark: SparkSession, sf_dir: str, delivery_dates: bool = True) -> RawTables:
    """``delivery_dates=False`` leaves the delivery date null and saves its join."""

    def read(name: str) -> DataFrame:
        # With the schema given, no job has to open the files first.
        return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")

    return RawTables(
        {
            "customers": lambda: _customers(read("customer")),
            "orders": lambda: _orders(read("orders"), read("lineitem"), delivery_dates),
            "order_items": lambda: _order_items(read("lineitem")),
            "order_payments": lambda: _order_payments(read("lineitem")),
            "order_reviews": lambda: _order_reviews(read("lineitem")),
            "products": lambda: _products(read("part")),
            "sellers": lambda: _sellers(read("supplier")),
            "geolocation": lambda: _geolocation(read("nation")),
            "product_category_translation": lambda: _translation(spark),
        }
    )


def _plus_days(column: str, days: int):
    return F.col(column) + F.make_dt_interval(F.lit(days))


def _customers(customer: DataFrame) -> DataFrame:
    return customer.select(
        F.col("c_custkey").alias("customer_id"),
        F.floor(F.col("c_custkey") / 2.0).cast("bigint").alias("customer_unique_id"),
        F.col("c_nationkey").cast("string").alias("customer_zip_code_prefix"),
        F.col("c_mktsegment").alias("customer_city"),
        F.concat(F.lit("S"), F.col("c_nationkey").cast("string")).alias("customer_state"),
    )


def _orders(orders: DataFrame, lines: DataFrame, delivery_dates: bool) -> DataFrame:
    out = orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.when(F.col("o_orderstatus") == "F", "delivered")
        .when(F.col("o_orderstatus") == "O", "shipped")
        .when(F.col("o_orderstatus") == "P", "processing")
        .alias("order_status"),
        F.col("o_orderdate").alias("order_purchase_timestamp"),
        _plus_days("o_orderdate", 1).alias("order_approved_at"),
        _plus_days("o_orderdate", 3).alias("order_delivered_carrier_date"),
        _plus_days("o_orderdate", 30).alias("order_estimated_delivery_date"),
    )
    if not delivery_dates:
        return out.withColumn("order_delivered_customer_date", F.lit(None).cast("timestamp_ntz"))
    shipped = (
        lines.filter(F.col("l_linestatus") == "F")
        .groupBy(F.col("l_orderkey").alias("order_id"))
        .agg(F.max("l_shipdate").alias("order_delivered_customer_date"))
    )
    return out.join(shipped, "order_id", "left")


def _hundredths(name: str):
    return F.floor(F.col(name) * 100.0 + 0.5)


def _order_items(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        F.col("l_extendedprice").alias("price"),
        (_hundredths("l_extendedprice") * _hundredths("l_tax") / 10000.0).alias("freight_value"),
    )


def _order_payments(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("payment_sequential"),
        F.when(F.col("l_returnflag") == "A", "credit_card").otherwise("voucher").alias("payment_type"),
        (F.col("l_quantity").cast("int") % 4 + 1).alias("payment_installments"),
        (_hundredths("l_extendedprice") * (100 - _hundredths("l_discount")) / 10000.0).alias("payment_value"),
    )


def _order_reviews(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("l_returnflag") == "R").select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("review_id"),
        F.col("l_orderkey").alias("order_id"),
        (F.col("l_quantity").cast("int") % 5 + 1).alias("review_score"),
        F.lit(None).cast("string").alias("review_comment_title"),
        F.col("l_linestatus").alias("review_comment_message"),
        F.col("l_shipdate").alias("review_creation_date"),
        _plus_days("l_shipdate", 2).alias("review_answer_timestamp"),
    )


def _products(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_type").alias("product_category_name"),
        F.length("p_name").alias("product_name_lenght"),
        F.length("p_brand").alias("product_description_lenght"),
        (F.col("p_size") % 5).alias("product_photos_qty"),
        (F.col("p_size") * 100).alias("product_weight_g"),
        F.col("p_size").alias("product_length_cm"),
        (F.col("p_size") + 1).alias("product_height_cm"),
        (F.col("p_size") + 2).alias("product_width_cm"),
    )


def _sellers(supplier: DataFrame) -> DataFrame:
    return supplier.select(
        F.col("s_suppkey").alias("seller_id"),
        F.col("s_nationkey").cast("string").alias("seller_zip_code_prefix"),
        F.col("s_name").alias("seller_city"),
        F.concat(F.lit("S"), F.col("s_nationkey").cast("string")).alias("seller_state"),
    )


def _geolocation(nation: DataFrame) -> DataFrame:
    return nation.select(
        F.col("n_nationkey").cast("string").alias("geolocation_zip_code_prefix"),
        F.col("n_nationkey").cast("double").alias("geolocation_lat"),
        F.col("n_regionkey").cast("double").alias("geolocation_lng"),
        F.col("n_name").alias("geolocation_city"),
        F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias("geolocation_state"),
    )


def _translation(spark: SparkSession) -> DataFrame:
    """Covers four of the six categories, so the fallback to the raw name is used."""
    return spark.sql(
        "SELECT * FROM VALUES ('STANDARD','standard goods'), ('MEDIUM','medium goods'), "
        "('LARGE','large goods'), ('ECONOMY','economy goods') "
        "AS t(product_category_name, product_category_name_english)"
    )
