"""The whole training job on transactions drawn from the purchase model."""

import datetime as dt
from functools import partial

import numpy as np
import pytest

from retenta.config import FEATURE_COLS
from retenta.operators import attribution, churn_model, features
from retenta.plans import registered_models, scoring, training
from retenta.sources import artifacts
from retenta.sources.retail import RawTables
from retenta.sources.schemas import RAW_SCHEMAS

START = dt.datetime(2017, 1, 1)


@pytest.fixture(scope="module")
def shop(spark):
    rng = np.random.default_rng(4)
    rows = {name: [] for name in RAW_SCHEMAS}
    rows["products"] = [(f"i{i}", f"cat{i % 6}", 1, 1, 1, 1, 1, 1, 1) for i in range(30)]
    for person in range(500):
        rate, leave = rng.gamma(0.9, 1 / 8.0), rng.beta(0.9, 2.5)
        day, spend = float(rng.integers(0, 300)), rng.gamma(4.0, 20.0)
        rows["customers"].append((f"c{person}", f"p{person}", "1", "x", "SP"))
        while day < 600:
            order, bought = f"o{len(rows['orders'])}", START + dt.timedelta(days=int(day))
            arrived = bought + dt.timedelta(days=int(rng.integers(1, 20)))
            rows["orders"].append((order, f"c{person}", "delivered", bought, None, None, arrived, arrived))
            paid = float(np.round(rng.gamma(6.0, spend / 6.0) + 0.01, 2))
            rows["order_payments"].append((order, 1, "boleto", int(rng.integers(1, 4)), paid))
            rows["order_items"].append((order, 1, f"i{rng.integers(0, 30)}", "s", None, 1.0, 2.5))
            if rng.random() < 0.7:
                rows["order_reviews"].append((f"r{order}", order, int(rng.integers(1, 6)), None, None, None, None))
            day += 7 * rng.exponential(1 / rate)
            if rng.random() < leave:
                break
    return RawTables({name: lambda name=name: spark.createDataFrame(rows[name], RAW_SCHEMAS[name]) for name in rows})


def test_training_then_scoring(spark, shop, tmp_path):
    models_dir, runs_dir = f"{tmp_path}/models", f"{tmp_path}/runs"
    scores = training.train(spark, shop, models_dir, runs_dir, n_trees=2)
    assert 0.5 < scores["test_roc_auc"] <= 1.0
    assert artifacts.load_metrics(spark, runs_dir).first()["test_roc_auc"] == scores["test_roc_auc"]
    bgnbd, gamma_gamma = artifacts.load_clv_params(spark, models_dir)
    assert all(value > 0 for value in (*bgnbd, *gamma_gamma))
    assert churn_model.load_churn_model(spark, f"{models_dir}/{training.CHURN_MODEL}").n_trees == 2

    matrix = training.feature_matrix(spark, shop, models_dir)
    assert {row[0] for row in matrix.select("churned").distinct().collect()} == {0, 1}
    predictions = scoring.run_batch_predictions(spark, shop, models_dir, f"{tmp_path}/predictions").collect()
    assert len({r["customer_unique_id"] for r in predictions}) == len(predictions) == 500
    assert all(0 <= r["churn_proba"] <= 1 and r["predicted_clv"] >= 0 for r in predictions)
    assert {r["churn_risk_tier"] for r in predictions} <= {"Low", "Medium", "High"}


def test_metrics_are_made_from_one_matrix(spark, monkeypatch):
    rng = np.random.default_rng(6)
    made = []

    def matrix(spark, sf_dir):
        made.append(sf_dir)
        rows = [(n, *rng.random(len(FEATURE_COLS)).tolist(), n % 3 // 2) for n in range(300)]
        return spark.createDataFrame(rows, ", ".join(["customer_unique_id bigint", *(f"{c} double" for c in FEATURE_COLS), "churned int"]))

    monkeypatch.setattr(registered_models, "_matrix", matrix)
    monkeypatch.setattr(churn_model, "train_churn_model", partial(churn_model.train_churn_model, n_trees=2))
    found = registered_models.churn_metrics(spark, "here").collect()
    assert len(found) == 1 and 0 <= found[0]["roc_auc"] <= 1
    assert made == ["here"]


@pytest.mark.parametrize("name", ["predict_churn", "feature_attribution"])
def test_training_and_scoring_share_one_pass_over_the_orders(spark, shop, monkeypatch, name):
    made, rows = [], features.order_basket_rows
    monkeypatch.setattr(churn_model, "train_churn_model", partial(churn_model.train_churn_model, n_trees=2))
    monkeypatch.setattr(registered_models, "raw_tables", lambda spark, sf_dir: shop)
    monkeypatch.setattr(registered_models, "CUTOFF", "2017-10-01")
    monkeypatch.setattr(registered_models, "WINDOW_DAYS", 120)
    monkeypatch.setattr(features, "order_basket_rows", lambda *args, **kw: made.append(1) or rows(*args, **kw))
    found = getattr(registered_models, name)(spark, "here").collect()
    assert made == [1]

    model, _ = registered_models._classifier(spark, "here")
    behavior = features.behavioral_features(
        shop.orders, shop.customers, shop.order_payments, shop.order_items, shop.order_reviews, shop.products
    )
    operator = churn_model.predict_churn if name == "predict_churn" else attribution.feature_attribution
    expected = {r["customer_unique_id"]: tuple(r) for r in operator(model, behavior).collect()}
    width = len(next(iter(expected.values())))
    assert {r["customer_unique_id"]: tuple(r)[:width] for r in found} == expected and len(expected) == 500
