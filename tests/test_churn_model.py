"""Training, scoring and attribution on customers whose churn follows two features."""

import json
from functools import lru_cache
from itertools import combinations
from math import exp, factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from retenta.config import FEATURE_COLS
from retenta.operators import attribution, churn_model, evaluate
from retenta.plans import evaluation, scoring, training
from retenta.sources import artifacts
from tests.test_clv import SPEND, TRUE


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(11)
    n = 600
    x = rng.normal(size=(n, 7))
    x[:, 6] = x[:, 6] > 0
    churned = (x[:, 0] + 0.8 * x[:, 2] * x[:, 6] + 0.3 * rng.normal(size=n) > 0.6).astype(int)
    rows = [(f"u{i}", *map(float, x[i]), int(churned[i])) for i in range(n)]
    rows[0] = (rows[0][0], *rows[0][1:3], None, *rows[0][4:])  # a missing review score
    schema = "customer_unique_id string, " + ", ".join(f"{c} double" for c in FEATURE_COLS) + ", churned int"
    return spark.createDataFrame(rows, schema).cache()


@pytest.fixture(scope="module")
def saved(spark, matrix, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("models"))
    split = training.split_matrix(matrix)
    model = churn_model.train_churn_model(training.part(split, "train"), n_trees=4)
    path = f"{folder}/{training.CHURN_MODEL}"
    churn_model.save_churn_model(spark, model, path)
    return folder, path, churn_model.load_churn_model(spark, path)


def test_model_learns_and_scores(matrix, saved):
    _, _, model = saved
    test = churn_model.score(model, training.part(training.split_matrix(matrix), "test"))
    assert evaluate.roc_auc(test, "churn_proba", "churned").first()[0] > 0.85
    for r in test.collect():
        assert 0 <= r["churn_proba"] <= 1 and r["prediction"] == int(r["churn_proba"] > 0.5)


def test_predictions_cover_every_row(matrix, saved):
    predicted = churn_model.predict_churn(saved[2], matrix)
    assert predicted.columns == ["customer_unique_id", "churn_proba", "churn_risk_tier"]
    assert predicted.filter(F.col("churn_proba").isNotNull()).count() == 600


def test_importance(spark, saved):
    rows = churn_model.feature_importance(spark, saved[2]).collect()
    assert rows[0]["feature"] == "monetary_value" and rows[0]["label"] == "Total Spend (R$)"
    assert sum(r["importance"] for r in rows) == pytest.approx(1.0) and len(rows) == 7


def test_class_weight(spark):
    labels = spark.createDataFrame([(0,), (0,), (0,), (1,)], "churned int")
    assert churn_model.class_weight(labels).first() == (3, 1, 3.0)
    assert churn_model.class_weight(labels.filter("churned = 0")).first() == (3, 0, 1.0)


def test_one_class_is_an_error(matrix):
    with pytest.raises(ValueError, match="both classes"):
        churn_model.train_churn_model(matrix.filter("churned = 0"))


def test_missing_model_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        churn_model.load_churn_model(spark, f"{tmp_path}/none")
    with pytest.raises(FileNotFoundError):
        artifacts.load_clv_params(spark, str(tmp_path))


def brute_force_shapley(model, x):
    """All 128 coalitions, each by walking every tree."""

    def walk(tree, place, known):
        f = model.feature[tree, place]
        if f < 0:
            return model.value[tree, place]
        left, right = 2 * place + 1, 2 * place + 2
        if f in known:
            goes_left = model.missing_left[tree, place] if np.isnan(x[f]) else x[f] <= model.threshold[tree, place]
            return walk(tree, left if goes_left else right, known)
        share = model.cover[tree, left] / model.cover[tree, place]
        return share * walk(tree, left, known) + (1 - share) * walk(tree, right, known)

    @lru_cache(None)
    def value(known):
        return sum(walk(tree, 0, known) for tree in range(model.n_trees))

    phi = []
    for i in range(7):
        rest = [j for j in range(7) if j != i]
        phi.append(
            sum(
                factorial(k) * factorial(6 - k) / factorial(7) * (value(frozenset({*s, i})) - value(frozenset(s)))
                for k in range(7)
                for s in combinations(rest, k)
            )
        )
    return value(frozenset()), phi


def test_attribution_is_exact(matrix, saved):
    model = saved[2]
    rows = attribution.feature_attribution(model, matrix).collect()
    assert len(rows) == 600
    proba = {r["customer_unique_id"]: r["churn_proba"] for r in churn_model.predict_churn(model, matrix).collect()}
    for r in rows:
        total = r["base_value"] + sum(r[f"phi_{c}"] for c in FEATURE_COLS)
        assert total == pytest.approx(r["log_odds"], abs=1e-9)
        assert 1 / (1 + exp(-total)) == pytest.approx(proba[r["customer_unique_id"]], abs=1e-9)
    vectors = {r[0]: np.array([np.nan if v is None else v for v in r[1:8]]) for r in matrix.collect()}
    explained = {r["customer_unique_id"]: r for r in rows}
    for who in [f"u{i}" for i in range(6)]:  # the first lacks a review score
        base, phi = brute_force_shapley(model, vectors[who])
        assert explained[who]["base_value"] == pytest.approx(base, abs=1e-9)
        assert [explained[who][f"phi_{c}"] for c in FEATURE_COLS] == pytest.approx(phi, abs=1e-9)


def test_validation_report_has_every_tree(matrix, saved):
    model, val = saved[2], training.part(training.split_matrix(matrix), "val")
    report = churn_model.validation_report(model, val).collect()
    assert [r["tree"] for r in report] == [0, 1, 2, 3]
    scored = churn_model.score(model, val)
    assert report[-1]["roc_auc"] == pytest.approx(evaluate.roc_auc(scored, "churn_proba", "churned").first()[0], abs=1e-12)


def test_training_labels_need_parameters_first(spark, edge_tables, tmp_path):
    with pytest.raises(FileNotFoundError):
        training.feature_matrix(spark, edge_tables, str(tmp_path))


def test_scoring_and_evaluation_jobs(spark, edge_tables, matrix, saved, tmp_path):
    folder, _, _ = saved
    artifacts.save_clv_params(spark, TRUE, SPEND, folder)
    assert artifacts.load_clv_params(spark, folder) == (TRUE, SPEND)
    lazy = scoring.run_batch_predictions(spark, edge_tables, folder)
    written = scoring.run_batch_predictions(spark, edge_tables, folder, f"{tmp_path}/predictions")
    assert sorted(written.collect()) == sorted(lazy.collect())
    assert {r["customer_unique_id"] for r in written.collect()} == {"p1", "p2", "p3", "p4"}
    assert written.filter("predicted_clv < 0").count() == 0

    metrics = evaluation.run_evaluation(spark, matrix, folder, f"{tmp_path}/runs")
    assert set(metrics) == {"roc_auc", "average_precision", "classification_report"}
    n_test = training.part(training.split_matrix(matrix), "test").count()
    assert spark.read.parquet(f"{tmp_path}/runs/attribution").count() == n_test
    curve = artifacts.read_roc_curve(spark, f"{tmp_path}/runs/roc_curve")
    assert curve.agg(F.max("tpr")).first()[0] == 1.0
    assert {r["auc"] for r in curve.select("auc").collect()} == {metrics["roc_auc"]}


class TestMetricsFile:
    def test_written_with_name_and_time(self, spark, tmp_path):
        path = artifacts.save_metrics(spark, {"roc_auc": 0.85, "avg_precision": 0.72}, "test_run", f"{tmp_path}/a/b/runs")
        assert "/test_run_" in path and path.endswith(".json")
        row = spark.read.json(path).first()
        assert (row["run_name"], row["roc_auc"], row["avg_precision"]) == ("test_run", 0.85, 0.72)
        assert len(row["timestamp"]) == len("20180101T000000")

    def test_other_values_become_text(self, spark, tmp_path):
        path = artifacts.save_metrics(spark, {"when": np.datetime64("2018-01-01")}, "r", str(tmp_path))
        assert json.loads(spark.read.text(path).first()[0])["when"] == "2018-01-01"

    def test_runs_add_up(self, spark, tmp_path):
        for name in ("one", "two"):
            artifacts.save_metrics(spark, {"v": 1}, name, str(tmp_path))
        assert artifacts.load_metrics(spark, str(tmp_path)).count() == 2
