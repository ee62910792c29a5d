import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from retenta.operators.profile import correlations, describe
from retenta.operators.ranking import exact_percentiles, running_totals, seeded_sample, stratified_split


@pytest.fixture(scope="module")
def skewed(spark):
    """Two groups; in one, a third of all rows share a value and most others crowd near it."""
    rng = np.random.default_rng(3)
    values = [("a", 0.5)] * 1000 + [("a", 0.5 + float(v) * 1e-9) for v in rng.normal(size=900)]
    values += [("b", float(v)) for v in rng.exponential(size=1100)] + [("b", None), ("b", math.nan)]
    rng.shuffle(values)
    rows = [(str(k), None if v is None else float(v)) for k, v in values]
    return spark.createDataFrame(rows, "k string, v double"), [(str(k), v) for k, v in rows]


def clean(rows, key):
    return np.array([v for k, v in rows if k == key and v is not None and not math.isnan(v)])


@pytest.mark.parametrize("tasks", [1, 4, 64])
def test_running_totals(spark, skewed, tasks):
    df, rows = skewed
    counts = df.filter("v is not null and not isnan(v)").groupBy("k", "v").agg(F.count("*").alias("n"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    got = running_totals(counts, ["k"], "v", ["n"], ["v"]).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    for key in "ab":
        values = clean(rows, key)
        mine = sorted((r["v"], r["n_upto"], r["n_all"], r["v_previous"]) for r in got if r["k"] == key)
        distinct = sorted(set(values))
        assert mine == [(v, (values <= v).sum(), len(values), w) for v, w in zip(distinct, [None, *distinct])]


def test_tasks_follow_the_session(spark, skewed):
    counts = skewed[0].filter("v is not null and not isnan(v)").groupBy("k", "v").agg(F.count("*").alias("n"))
    for setting, value in (("spark.sql.shuffle.partitions", "13"), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        spark.conf.set(setting, value)
    files = running_totals(counts, ["k"], "v", ["n"]).inputFiles()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(set(files)) == 13


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.777, 1.0])
def test_exact_percentiles(skewed, p):
    df, rows = skewed
    for r in exact_percentiles(df, ["k"], "v", {"q": p}).collect():
        assert r["q"] == pytest.approx(np.quantile(clean(rows, r["k"]), p), rel=1e-15)


def test_percentile_of_one_value(spark):
    df = spark.createDataFrame([(7.0,)], "v double")
    assert exact_percentiles(df, [], "v", {"q": 0.25}).first()["q"] == 7.0


def test_describe(skewed):
    df, rows = skewed
    both = df.select(F.when(F.col("k") == "a", F.col("v")).alias("a"), F.when(F.col("k") == "b", F.col("v")).alias("b"))
    for r in describe(both, ["a", "b"]).collect():
        values = clean(rows, r["feature"])
        assert r["count"] == len(values)
        assert r["mean"] == pytest.approx(values.mean()) and r["std"] == pytest.approx(values.std(ddof=1), rel=1e-6)
        assert (r["min"], r["max"]) == (values.min(), values.max())
        assert [r["p25"], r["p50"], r["p75"]] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.75])), rel=1e-15)


def test_correlations_skip_missing_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.5), (3.0, 5.0), (4.0, None)], "a double, b double")
    got = {(r["feature_a"], r["feature_b"]): r["correlation"] for r in correlations(df, ["a", "b"]).collect()}
    assert got["a", "b"] == got["b", "a"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4.5, 5])[0, 1])
    assert got["a", "a"] == pytest.approx(1.0) and len(got) == 4


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.5)], "a double, b double")
    got = {(r["feature_a"], r["feature_b"]): r["correlation"] for r in correlations(df, ["a", "b"]).collect()}
    assert got["a", "b"] is None and got["a", "a"] is None and got["b", "b"] == pytest.approx(1.0)


def test_split_is_exact_repeatable_and_whole(spark):
    df = spark.range(2003).select(F.col("id").alias("who"), (F.col("id") % 7 == 0).cast("int").alias("y"))
    first = stratified_split(df, "who", "y", 0.7, 0.15, 42, hex_digits=2)
    second = stratified_split(df.repartition(5), "who", "y", 0.7, 0.15, 42, hex_digits=3)
    assert sorted(first.collect()) == sorted(second.collect())
    counts = {(r["y"], r["split"]): r["count"] for r in first.groupBy("y", "split").count().collect()}
    for label, n in ((0, 1716), (1, 287)):
        assert counts[label, "train"] == round(n * 0.7)
        assert counts[label, "train"] + counts[label, "val"] == round(n * 0.85)
        assert sum(counts[label, s] for s in ("train", "val", "test")) == n
    other = stratified_split(df, "who", "y", 0.7, 0.15, 7)
    assert sorted(first.collect()) != sorted(other.collect())


def test_split_of_odd_classes_needs_no_window(spark):
    rows = [(i, None) for i in range(10)] + [(100 + i, "one") for i in range(1)] + [(200 + i, "three") for i in range(3)]
    df = spark.createDataFrame(rows, "who bigint, y string").union(spark.range(40).selectExpr("999L", "'same id'"))
    split = stratified_split(df, "who", "y", 0.7, 0.15, 42, hex_digits=5)
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange hashpartitioning" not in plan
    counts = {(r["y"], r["split"]): r["count"] for r in split.groupBy("y", "split").count().collect()}
    assert counts == {
        (None, "train"): 7, (None, "val"): 2, (None, "test"): 1, ("one", "train"): 1,
        ("three", "train"): 2, ("three", "val"): 1, ("same id", "train"): 40,
    }
    assert stratified_split(df.limit(0), "who", "y", 0.7, 0.15, 42).collect() == []


def test_sample_is_repeatable(spark):
    df = spark.range(1000).withColumnRenamed("id", "who")
    once = {r[0] for r in seeded_sample(df, "who", 50, 1).collect()}
    assert once == {r[0] for r in seeded_sample(df.repartition(9), "who", 50, 1).collect()}
    assert len(once) == 50 and once != {r[0] for r in seeded_sample(df, "who", 50, 2).collect()}
    assert seeded_sample(df, "who", 5000, 1).count() == 1000
