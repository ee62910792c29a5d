"""One computation for several uses of a frame within one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALLEST_HASH = -(2**31)


def computed_once(df: DataFrame) -> DataFrame:
    """The same rows, behind a condition that is always true and reads every column.

    Spark reuses a shuffle only where two uses of a frame need the very same columns, and
    column pruning makes them differ: one use of an aggregate keeps its date, another its
    sums, and the joins beneath run twice. With the condition no column can be pruned off,
    so the shuffle under ``df`` runs once, with nothing to persist or to lose.
    """
    return df.filter(F.hash(*df.columns) >= F.lit(SMALLEST_HASH))
