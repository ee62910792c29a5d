"""Ranks, running totals and percentiles over a global order, without a one-task sort.

A window with no partition, or with one partition per class, puts a whole table into one
task. Running totals come from rows dealt out by ranges (``prefix_sums``), in as many tasks
as the session shuffles into.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from retenta.functions.scalars import shuffled_key
from retenta.operators.prefix_sums import running_sums

#: Digits of a key of shuffled rows, and a letter that sorts after all of them.
KEY_DIGITS, PAST_DIGITS = 32, "g"


def running_totals(
    rows: DataFrame, keys: list[str], value: str, sums: list[str], previous: list[str] | None = None
) -> DataFrame:
    """Add, for each column in ``sums``, its total up to and including the row in the order of ``value``
    (``<name>_upto``) and its total over the key (``<name>_all``); and ``<name>_previous`` as wanted.

    ``rows`` must hold each (keys, value) once.
    """
    summed = running_sums(rows, keys, [value], sums, previous)
    totals = summed.groupBy(*keys).agg(*[F.sum(name).alias(f"{name}_all") for name in sums])
    return summed.join(totals, keys) if keys else summed.crossJoin(F.broadcast(totals))


def exact_percentiles(
    rows: DataFrame,
    keys: list[str],
    value: str,
    probabilities: dict[str, float],
) -> DataFrame:
    """Exact percentiles per key, linear between neighbours; nulls and NaN are left out.

    ``F.percentile`` would hold every distinct value of a key in one buffer. Equal values
    are counted before the shuffle, so a value that is very common costs one row.
    """
    counted = (
        rows.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
        .groupBy(*keys, value)
        .agg(F.count("*").alias("n"))
    )
    ranked = running_totals(counted, keys, value, ["n"])
    last = F.col("n_upto") - 1
    first = F.col("n_upto") - F.col("n")
    aggregates = []
    for name, p in probabilities.items():
        at = (F.col("n_all") - 1) * F.lit(p)
        for side, index in (("low", F.floor(at)), ("high", F.ceil(at))):
            aggregates.append(F.max(F.when((first <= index) & (index <= last), F.col(value))).alias(f"{name}_{side}"))
    picked = ranked.groupBy(*keys).agg(*aggregates, F.max("n_all").alias("n_all"))
    columns = []
    for name, p in probabilities.items():
        at = (F.col("n_all") - 1) * F.lit(p)
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        columns.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return picked.select(*keys, *columns)


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """``n`` rows at random, the same ones on every run; each task keeps at most ``n``."""
    return df.orderBy(shuffled_key(id_col, seed), F.col(id_col)).limit(n)


def _cut_keys(hashed: DataFrame, label: str, shares: list[float], hex_digits: int) -> list[tuple]:
    """(class, a key per share): the rows of a class up to the key are that share of it, rounded.

    Keys are counted by a growing number of leading digits, each time only behind the prefixes in which a
    cut lies, until the cut is at the end of a prefix. The driver gets at most 16**hex_digits counts per cut.
    """
    spark, kind = hashed.sparkSession, hashed.schema[label].dataType
    whole = {row[0]: row["n"] for row in hashed.groupBy(label).agg(F.count("*").alias("n")).collect()}
    # Per class and share: the prefix in which the cut lies, and how many of its rows are up to the cut; 0 once that is known.
    cuts = {(cls, k): ("", int(n * share + 0.5)) for cls, n in whole.items() for k, share in enumerate(shares)}
    levels = [*range(0, KEY_DIGITS, hex_digits), KEY_DIGITS]
    for before, digits in zip(levels, levels[1:]):
        open_cuts = {cut: at for cut, at in cuts.items() if at[1]}
        if not open_cuts:
            break
        wanted = sorted({(cls, prefix) for (cls, _), (prefix, _) in open_cuts.items()}, key=str)
        prefixes = spark.createDataFrame(wanted, StructType([StructField("_class", kind), StructField("_prefix", StringType())]))
        inside = hashed.join(
            F.broadcast(prefixes),  # at most one row per class and cut
            F.col(label).eqNullSafe(F.col("_class")) & (F.substring("_key", 1, before) == F.col("_prefix")),
            "left_semi",
        )
        counts: dict[tuple, list] = {}
        for cls, prefix, n in inside.groupBy(label, F.substring("_key", 1, digits)).agg(F.count("*")).collect():
            counts.setdefault((cls, prefix[:before]), []).append((prefix, n))
        for cut, (prefix, rank) in open_cuts.items():
            for longer, n in sorted(counts[cut[0], prefix]):
                if rank <= n:
                    # Past all digits of the prefix, if the cut is at its end. Rows of one whole key stay together.
                    cuts[cut] = (longer + PAST_DIGITS, 0) if rank == n or digits == KEY_DIGITS else (longer, rank)
                    break
                rank -= n
    return [(cls, *(cuts[cls, k][0] for k in range(len(shares)))) for cls in whole]


def stratified_split(
    df: DataFrame,
    id_col: str,
    label: str,
    train_ratio: float,
    val_ratio: float,
    seed: int,
    hex_digits: int = 3,
) -> DataFrame:
    """Add ``split`` (train / val / test) with the shares met exactly in each class.

    The rows of a class are cut at two values of a hash of their id, which are found from counts. Rows of one
    id stay together. Give a written frame: it is read for each three digits of the hash that the cuts need, about
    two or three times, and by the result.
    """
    hashed = df.withColumn("_key", shuffled_key(id_col, seed))
    found = _cut_keys(hashed.select(label, "_key"), label, [train_ratio, train_ratio + val_ratio], hex_digits)
    schema = StructType([StructField("_class", df.schema[label].dataType), StructField("_train", StringType()), StructField("_val", StringType())])
    cuts = df.sparkSession.createDataFrame(found, schema)
    # One row per class; the driver has held them all.
    return (
        hashed.join(F.broadcast(cuts), F.col(label).eqNullSafe(F.col("_class")))
        .withColumn(
            "split",
            F.when(F.col("_key") <= F.col("_train"), "train").when(F.col("_key") <= F.col("_val"), "val").otherwise("test"),
        )
        .select(*df.columns, "split")
    )
