"""Files a run leaves behind: predictions, metrics, fitted parameters, curves."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retenta.functions.clv import BGNBDParams, GammaGammaParams
from retenta.sources.schemas import PREDICTION_SCHEMA
from retenta.sources.warehouse import read_csv, require_path


def write_predictions(predictions: DataFrame, path: str | None) -> None:
    """CSV with a header; a ``None`` path writes nothing."""
    if path is not None:
        (
            predictions.select(*PREDICTION_SCHEMA.fieldNames())
            .write.mode("overwrite")
            .option("header", True)
            .option("escape", '"')
            .csv(path)
        )


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    require_path(spark, path, "Run the batch scoring job first.")
    return read_csv(spark, path, PREDICTION_SCHEMA)


def _write_json_row(spark: SparkSession, payload: dict[str, Any], path: str, mode: str) -> None:
    line = json.dumps(payload, default=str)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode(mode).text(path)


def save_metrics(spark: SparkSession, metrics: dict[str, Any], run_name: str, runs_dir: str) -> str:
    """One JSON row under ``<runs_dir>/<run_name>_<UTC time>.json``; returns that path."""
    # The stamp's format, the file's name and the order of its keys.
    timestamp = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S")
    path = f"{runs_dir}/{run_name}_{timestamp}.json"
    _write_json_row(spark, {"run_name": run_name, "timestamp": timestamp, **metrics}, path, "overwrite")
    return path


def load_metrics(spark: SparkSession, runs_dir: str) -> DataFrame:
    return spark.read.json(f"{runs_dir}/*.json")


def save_clv_params(spark: SparkSession, bgnbd: BGNBDParams, gamma_gamma: GammaGammaParams, models_dir: str) -> None:
    _write_json_row(spark, bgnbd._asdict(), f"{models_dir}/clv_bgnbd.json", "overwrite")
    _write_json_row(spark, gamma_gamma._asdict(), f"{models_dir}/clv_gg.json", "overwrite")


def _load_params(spark: SparkSession, path: str, kind):
    require_path(spark, path, "Run the training job first.")
    schema = ", ".join(f"{name} double" for name in kind._fields)
    row = spark.read.schema(schema).json(path).first()
    return kind(**row.asDict())


def load_bgnbd_params(spark: SparkSession, models_dir: str) -> BGNBDParams:
    return _load_params(spark, f"{models_dir}/clv_bgnbd.json", BGNBDParams)


def load_clv_params(spark: SparkSession, models_dir: str) -> tuple[BGNBDParams, GammaGammaParams]:
    return (
        load_bgnbd_params(spark, models_dir),
        _load_params(spark, f"{models_dir}/clv_gg.json", GammaGammaParams),
    )


def write_roc_curve(curve: DataFrame, auc: float | None, path: str) -> None:
    """The points of a curve, each with the area under all of it."""
    curve.withColumn("auc", F.lit(auc).cast("double")).write.mode("overwrite").parquet(path)


def read_roc_curve(spark: SparkSession, path: str) -> DataFrame:
    require_path(spark, path, "Run the evaluation job first.")
    return spark.read.parquet(path)
