"""CSV ingest into catalog tables, and scans of those tables."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from retenta.sources.csv_records import read_multiline_csv
from retenta.sources.schemas import RAW_SCHEMAS

log = logging.getLogger(__name__)

# Free text can hold line breaks, so records of reviews are told from lines by their quotes.
MULTILINE_TABLES = {"order_reviews"}
ORDER_GRAIN_TABLES = ("orders", "order_items", "order_payments", "order_reviews")


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path)


def require_path(spark: SparkSession, path: str, hint: str) -> None:
    if not path_exists(spark, path):
        raise FileNotFoundError(f"nothing found at {path}. {hint}")


def read_csv(spark: SparkSession, path: str, schema: StructType, multiline: bool = False) -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def create_warehouse(
    spark: SparkSession,
    raw_files: dict[str, str],
    database: str = "default",
    order_buckets: int | None = None,
    location: str | None = None,
) -> DataFrame:
    """Load every CSV into ``<database>.raw_<key>``, replacing what is there.

    An absent file is skipped with a warning. ``order_buckets`` writes the four tables
    keyed by ``order_id`` bucketed and sorted on it, so that per-order sums and joins
    read co-located data and shuffle nothing. ``location`` keeps the files outside of the
    catalog's own warehouse folder. Returns one report row per source:
    ``table_name``, ``status`` (loaded / missing), ``row_count``.
    """
    report = None
    for key, path in raw_files.items():
        table = f"{database}.raw_{key}"
        if not path_exists(spark, path):
            log.warning("source file not found, skipping: %s", path)
            row = spark.range(1).select(
                F.lit(f"raw_{key}").alias("table_name"),
                F.lit("missing").alias("status"),
                F.lit(None).cast("bigint").alias("row_count"),
            )
        else:
            read = read_multiline_csv if key in MULTILINE_TABLES else read_csv
            frame = read(spark, path, RAW_SCHEMAS[key])
            writer = frame.write.mode("overwrite").format("parquet")
            if order_buckets and key in ORDER_GRAIN_TABLES:
                writer = writer.bucketBy(order_buckets, "order_id").sortBy("order_id")
            if location:
                writer = writer.option("path", f"{location}/raw_{key}")
            writer.saveAsTable(table)
            row = spark.table(table).agg(F.count("*").alias("row_count")).select(
                F.lit(f"raw_{key}").alias("table_name"),
                F.lit("loaded").alias("status"),
                "row_count",
            )
        report = row if report is None else report.unionByName(row)
    return report


def load_table(spark: SparkSession, table_name: str, database: str = "default") -> DataFrame:
    return spark.table(f"{database}.{table_name}")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name``, ``row_count`` for each frame; one small row per table."""
    out = None
    for name, frame in tables.items():
        row = frame.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = row if out is None else out.unionByName(row)
    return out
