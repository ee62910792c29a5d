"""Boosted-tree churn classifier on the seven behaviour features."""

from __future__ import annotations

from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retenta.config import FEATURE_COLS, RANDOM_SEED
from retenta.functions.scalars import feature_label, risk_tier
from retenta.operators import boosted_trees, evaluate
from retenta.operators.boosted_trees import BoostedTrees
from retenta.sources.warehouse import require_path

# Settings of the trees.
N_TREES = 300
MAX_DEPTH = 5
LEARNING_RATE = 0.05
ROW_SHARE = 0.8
FEATURE_SHARE = 0.8
# End of fixed values.


def class_weight(labelled: DataFrame, label: str = "churned") -> DataFrame:
    """Negatives per positive, 1.0 without positives, in one row with both counts."""
    counts = labelled.agg(
        F.count(F.when(F.col(label) == 0, 1)).alias("n_negative"),
        F.count(F.when(F.col(label) == 1, 1)).alias("n_positive"),
    )
    ratio = F.try_divide(F.col("n_negative").cast("double"), F.col("n_positive").cast("double"))
    return counts.withColumn("positive_weight", F.coalesce(ratio, F.lit(1.0)))


def standard_scaler(columns: list[str], output: str = "features") -> list:
    """Stages that put columns in a vector and scale it to mean 0 and deviation 1."""
    return [
        VectorAssembler(inputCols=columns, outputCol="assembled"),
        StandardScaler(inputCol="assembled", outputCol=output, withMean=True, withStd=True),
    ]


def with_double_features(df: DataFrame) -> DataFrame:
    return df.withColumns({name: F.col(name).cast("double") for name in FEATURE_COLS})


def fill_and_scale() -> list:
    """Stages that fill gaps with the median and scale all features."""
    filled = [f"{name}_filled" for name in FEATURE_COLS]
    return [Imputer(inputCols=FEATURE_COLS, outputCols=filled, strategy="median"), *standard_scaler(filled)]


def train_churn_model(
    train: DataFrame,
    label: str = "churned",
    n_trees: int = N_TREES,
    seed: int = RANDOM_SEED,
    id_col: str = "customer_unique_id",
) -> BoostedTrees:
    """Fit the trees on the training rows only.

    Give a staged frame: it is read for the classes, the cut points and the bins. Positives weigh as
    much in sum as negatives. Missing values go where each split gains most; trees need no scaling.
    """
    balance = class_weight(train, label).first()
    if not balance["n_positive"] or not balance["n_negative"]:
        raise ValueError(f"both classes are needed to train, found {balance.asDict()}")
    settings = boosted_trees.Settings(n_trees, MAX_DEPTH, LEARNING_RATE, ROW_SHARE, FEATURE_SHARE, seed=seed)
    labelled = train.filter(F.col(label).isNotNull())
    return boosted_trees.fit(labelled, FEATURE_COLS, label, id_col, float(balance["positive_weight"]), settings)


def validation_report(model: BoostedTrees, rows: DataFrame, label: str = "churned") -> DataFrame:
    """(tree, roc_auc): the metric of labelled rows after each tree, from tree 0 on."""
    counts = boosted_trees.scores_by_tree(model, rows, label)
    return evaluate.roc_auc_of_counts(counts, ["tree"], "margin").orderBy("tree")


def save_churn_model(spark: SparkSession, model: BoostedTrees, path: str) -> None:
    boosted_trees.save(spark, model, path)


def load_churn_model(spark: SparkSession, path: str) -> BoostedTrees:
    require_path(spark, path, "Run the training job first.")
    return boosted_trees.load(spark, path)


def score(model: BoostedTrees, rows: DataFrame) -> DataFrame:
    """Add ``churn_proba`` and ``prediction`` and keep the rows' own columns."""
    probability = 1.0 / (1.0 + F.exp(-F.col("_margin")))
    return (
        boosted_trees.margins(model, rows, "_margin")
        .withColumn("churn_proba", probability)
        .withColumn("prediction", (F.col("churn_proba") > 0.5).cast("int"))
        .drop("_margin")
    )


def predict_churn(model: BoostedTrees, features: DataFrame) -> DataFrame:
    """``customer_unique_id``, ``churn_proba``, ``churn_risk_tier`` for every person."""
    scored = score(model, features.select("customer_unique_id", *FEATURE_COLS))
    return scored.select("customer_unique_id", "churn_proba", risk_tier("churn_proba").alias("churn_risk_tier"))


def feature_importance(spark: SparkSession, model: BoostedTrees) -> DataFrame:
    """Mean gain of each feature's splits as a share of all, largest first, with its display name."""
    rows = spark.createDataFrame(list(boosted_trees.importance(model).items()), "feature string, importance double")
    return rows.select("feature", feature_label("feature").alias("label"), "importance").orderBy(
        F.desc("importance"), "feature"
    )
