"""Summary statistics and correlations of feature columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retenta.functions.scalars import present
from retenta.operators.selection import exact_quantiles
from retenta.session import staged

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
MEASURES = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def melt(df: DataFrame, columns: list[str], name_col: str = "feature", value_col: str = "value") -> DataFrame:
    """One row per row and column: the column's name and its value as double."""
    pairs = [
        F.struct(F.lit(name).alias(name_col), F.col(name).cast("double").alias(value_col)) for name in columns
    ]
    return df.select(F.inline(F.array(*pairs)))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles (exact, linear) and max of each column.

    The columns are written once and read by one aggregate for the moments and by the passes that
    select the quartiles; no value is shuffled.
    """
    spark = df.sparkSession
    with staged(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), "columns") as values:
        row = values.agg(
            *[of(present(c)).alias(f"{name}_{i}") for i, c in enumerate(columns) for name, of in MEASURES.items()]
        ).first()
        quartiles = exact_quantiles(values, columns, list(QUARTILES.values()))
    rows = [(c, *(row[f"{name}_{i}"] for name in MEASURES), *quartiles[c]) for i, c in enumerate(columns)]
    names = [*MEASURES, *QUARTILES]
    schema = "feature string, " + ", ".join(f"{name} {'bigint' if name == 'count' else 'double'}" for name in names)
    return spark.createDataFrame(rows, schema).select("feature", "count", "mean", "std", "min", *QUARTILES, "max")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of each pair, both ways, over rows where both are present.

    One aggregate row holds the joint and own deviations of all pairs, each as counts, means and
    co-moments that merge without loss for columns far from zero; the driver gets that row. Null
    where a column does not vary.
    """

    def value(name: str) -> Column:
        return F.col(name).cast("double")

    def where(name: str, other: str) -> Column:
        return F.when(value(other).isNotNull(), value(name))

    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    cells = []
    for k, (a, b) in enumerate(pairs):
        cells += [
            F.covar_pop(value(a), value(b)).alias(f"joint{k}"),
            F.stddev_pop(where(a, b)).alias(f"left{k}"),
            F.stddev_pop(where(b, a)).alias(f"right{k}"),
        ]
    row, rows = df.agg(*cells).first(), []
    for k, (a, b) in enumerate(pairs):
        joint, spread = row[f"joint{k}"], (row[f"left{k}"] or 0.0) * (row[f"right{k}"] or 0.0)
        found = joint / spread if joint is not None and spread else None
        rows += [(a, b, found)] if a == b else [(a, b, found), (b, a, found)]
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, correlation double")
