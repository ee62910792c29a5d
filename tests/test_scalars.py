import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from retenta.functions import scalars
from retenta.functions.special import digamma, lgamma, trigamma


def one(spark, column, sql):
    return spark.sql(sql).select(column).first()[0]


def test_days_between_counts_midnights(spark):
    days = scalars.days_between(F.col("a"), F.col("b"))
    frame = "SELECT TIMESTAMP_NTZ'{}' AS a, TIMESTAMP_NTZ'{}' AS b"
    assert one(spark, days, frame.format("2018-01-01 23:00:00", "2018-01-02 01:00:00")) == 1
    assert one(spark, days, frame.format("2018-01-02 00:00:00", "2018-01-02 23:59:59")) == 0
    assert one(spark, days, frame.format("2018-01-05 10:00:00", "2018-01-04 23:00:00")) == -1


def test_risk_tier_edges(spark):
    cases = {
        0.0: "Low", 0.33: "Low", 0.3300001: "Medium", 0.66: "Medium", 0.6600001: "High", 1.0: "High",
        1.0000001: "nan", -0.1: "nan", math.nan: "nan", None: "nan",
    }
    frame = spark.createDataFrame([(p,) for p in cases], "p double")
    assert [row[0] for row in frame.select(scalars.risk_tier("p")).collect()] == list(cases.values())


def test_clip_keeps_null_and_nan(spark):
    frame = spark.createDataFrame([(-1.0,), (2.0,), (None,), (math.nan,)], "v double")
    values = [row[0] for row in frame.select(scalars.at_least_zero(F.col("v"))).collect()]
    assert values[:3] == [0.0, 2.0, None] and math.isnan(values[3])


def test_repeat_count(spark):
    frame = spark.createDataFrame([(0,), (1,), (5,), (None,)], "n bigint")
    assert [row[0] for row in frame.select(scalars.repeat_count("n")).collect()] == [0, 0, 4, None]


def test_feature_label_falls_back(spark):
    frame = spark.createDataFrame([("monetary_value",), ("other",)], "f string")
    assert [r[0] for r in frame.select(scalars.feature_label("f")).collect()] == ["Total Spend (R$)", "other"]


def test_mean_amount_of_nothing_is_null(spark):
    assert one(spark, scalars.mean_amount("t", "n"), "SELECT CAST(NULL AS DECIMAL(28,0)) AS t, 0L AS n") is None


def test_money_sums_are_exact(spark):
    frame = spark.range(1000).select((F.lit(0.1) + F.col("id") * 0).alias("v")).repartition(7)
    total = frame.agg(F.sum(scalars.money("v")).alias("t")).select(scalars.amount("t")).first()[0]
    assert total == 100.0


def test_log_gamma_and_its_derivatives(spark):
    for z in (1e-3, 0.3, 1.0, 2.5, 17.0, 4000.0):
        assert math.isclose(lgamma(z), math.lgamma(z), rel_tol=1e-11, abs_tol=1e-11)
        h = 1e-5 * z
        assert math.isclose(digamma(z), (math.lgamma(z + h) - math.lgamma(z - h)) / (2 * h), rel_tol=1e-5, abs_tol=1e-6)
        assert math.isclose(trigamma(z), (digamma(z + h) - digamma(z - h)) / (2 * h), rel_tol=1e-6)
    frame = spark.createDataFrame([(0.7,), (12.0,)], "z double")
    for row in frame.select("z", lgamma(F.col("z")).alias("g")).collect():
        assert math.isclose(row["g"], math.lgamma(row["z"]), rel_tol=1e-11)


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), float("-inf")])
def test_amounts_that_are_no_number_stop_the_job(spark, bad):
    frame = spark.createDataFrame([(1.0,), (bad,), (2.0,)], "spend double")
    with pytest.raises(Exception, match="spend is not a finite amount"):
        frame.agg(F.sum(scalars.money("spend"))).collect()


def test_sums_of_unit_parts_are_exact(spark):
    values = [0, -1, 10**9, 10**9 - 1, -(10**18), 2**63 - 1, -(2**63), 2**63, 3 * 10**36 + 7, -(10**35) - 123456789012, None]
    frame = spark.createDataFrame([(i % 3, v if v is None else Decimal(v)) for i, v in enumerate(values * 3)], "g int, u decimal(38,0)")
    parts = frame.withColumns(scalars.unit_parts("u"))
    names = list(scalars.unit_parts("u"))
    assert [r[0] for r in parts.select(scalars.from_unit_parts("u")).collect()] == [r.u for r in frame.collect()]
    summed = parts.groupBy("g").agg(*[F.sum(n).alias(n) for n in names]).select("g", scalars.from_unit_parts("u").alias("s"))
    assert sorted(summed.collect()) == sorted(frame.groupBy("g").agg(F.sum("u")).collect())
    assert dict(parts.dtypes)["u_2"] == "bigint" and summed.schema["s"].dataType.simpleString() == "decimal(38,0)"


def test_money_sum_is_the_sum_of_money(spark):
    frame = spark.createDataFrame([(i % 4, None if i % 4 == 3 else (-1) ** i * 9.9e13 + i * 0.37) for i in range(200)], "g int, v double")
    found = frame.groupBy("g").agg(scalars.money_sum("v").alias("s"), F.sum(scalars.money("v")).alias("t"))
    assert found.schema["s"].dataType == found.schema["t"].dataType
    assert all(r.s == r.t for r in found.collect()) and found.filter("s IS NULL").count() == 1
