"""Boosted trees against a plain fit that tries every split of every node on the raw values."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from retenta.operators import boosted_trees as B

NAMES = [f"f{j}" for j in range(5)]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    n = 700
    x = rng.normal(size=(n, 5)).round(1)
    x[:, 1] = rng.integers(0, 3, n)
    x[rng.random((n, 5)) < 0.1] = np.nan
    x[:, 4] = 1.0
    y = (np.nan_to_num(x[:, 0]) + np.nan_to_num(x[:, 2]) * (x[:, 1] == 1) + np.isnan(x[:, 3]) + 0.3 * rng.normal(size=n) > 0.5).astype(int)
    frame = pd.DataFrame({**{name: x[:, j] for j, name in enumerate(NAMES)}, "y": y, "who": [f"p{i}" for i in range(n)]})
    df = spark.createDataFrame(frame).withColumns({name: F.nanvl(name, F.lit(None).cast("double")) for name in ("f0", "f3")})
    return df, x, y


def plain_fit(x, y, keys, cuts, weight, settings):
    """Nodes by recursion, sums over the rows themselves."""
    gradients = B.gradient_function(weight, settings.seed, settings.row_share)
    margin, trees = np.zeros(len(y)), []
    for tree in range(settings.n_trees):
        k = max(1, int(settings.feature_share * x.shape[1]))
        subset = sorted(np.random.default_rng([settings.seed, tree]).choice(x.shape[1], k, replace=False).tolist())
        g, h, chosen = gradients(margin, y, keys, tree)
        nodes = {}

        def score(own):
            return (g[own].sum() / B.UNIT) ** 2 / (h[own].sum() / B.UNIT + settings.ridge)

        def grow(place, own, everyone, level):
            best = None
            for f in subset if level < settings.depth else []:
                for missing_left in (False, True):
                    for cut in [*cuts[f], math.inf]:
                        left = np.where(np.isnan(x[:, f]), missing_left, x[:, f] <= cut)
                        a, b = own & left, own & ~left
                        if min(h[a].sum(), h[b].sum()) < settings.least_hessian * B.UNIT:
                            continue
                        gain = 0.5 * (score(a) + score(b) - score(own))
                        if gain > B.LEAST_GAIN and (best is None or gain > best[0]):
                            best = gain, f, cut, missing_left, left
            if best is None:
                value = -settings.rate * g[own].sum() / (h[own].sum() + settings.ridge * B.UNIT)
                margin[everyone] += value
                nodes[place] = value
                return
            nodes[place] = best[:4]
            grow(2 * place + 1, own & best[4], everyone & best[4], level + 1)
            grow(2 * place + 2, own & ~best[4], everyone & ~best[4], level + 1)

        before = margin.copy()
        margin = before.copy()
        grow(0, chosen, np.ones(len(y), bool), 0)
        trees.append(nodes)
    return trees, margin


@pytest.mark.parametrize("blocks", [1, 4])
def test_same_trees_as_a_plain_fit(spark, data, blocks, monkeypatch):
    df, x, y = data
    monkeypatch.setattr(B, "BLOCK_ROWS", 800 // blocks)
    monkeypatch.setattr(B, "MARGIN_TREES", 3)
    monkeypatch.setattr(B, "DIRECT_TASKS", 2)
    settings = B.Settings(n_trees=7, depth=3, rate=0.3, seed=9)
    model = B.fit(df.repartition(3), NAMES, "y", "who", 2.0, settings)
    cuts = B.cut_points(df, NAMES)
    keys = np.array([r[0] for r in df.orderBy(F.substring("who", 2, 9).cast("int")).select(F.xxhash64("who", F.lit(9))).collect()])
    trees, margin = plain_fit(x, y, keys, cuts, 2.0, settings)
    for t, nodes in enumerate(trees):
        for place, node in nodes.items():
            if isinstance(node, tuple):
                gain, f, cut, missing_left = node
                assert model.feature[t, place] == f and model.gain[t, place] == pytest.approx(gain)
                assert (model.threshold[t, place], bool(model.missing_left[t, place])) == (cut, missing_left)
            else:
                assert model.feature[t, place] == -1 and model.value[t, place] == pytest.approx(node, abs=1e-12)
        assert (model.feature[t] >= 0).sum() == sum(isinstance(n, tuple) for n in nodes.values())
    scored = {r["who"]: r["margin"] for r in B.margins(model, df).collect()}
    assert [scored[f"p{i}"] for i in range(len(y))] == pytest.approx(margin.tolist(), abs=1e-9)


def test_model_is_the_same_on_any_layout_and_after_saving(spark, data, tmp_path):
    df, _, _ = data
    settings = B.Settings(n_trees=3, depth=3)
    one, other = (B.fit(df.repartition(k), NAMES, "y", "who", 1.0, settings) for k in (1, 6))
    B.save(spark, one, str(tmp_path))
    for model in (other, B.load(spark, str(tmp_path))):
        for name in ("feature", "threshold", "missing_left", "value", "gain", "cover"):
            used = (one.feature >= 0) | (one.cover > 0)
            assert np.array_equal(getattr(one, name)[used], getattr(model, name)[used]), name
        assert model.features == one.features


def test_missing_values_take_the_better_side(spark):
    rows = [(i, None if i % 2 else float(i % 10), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "who bigint, f0 double, y int")
    model = B.fit(df, ["f0"], "y", "who", 1.0, B.Settings(n_trees=1, depth=1, row_share=1.0))
    assert model.threshold[0, 0] >= 8.0 and not model.missing_left[0, 0]
    assert model.value[0, 1] < 0 < model.value[0, 2]


def test_features_without_values_and_importance(spark, data):
    df, _, _ = data
    empty = df.withColumn("f2", F.lit(None).cast("double"))
    model = B.fit(empty, NAMES, "y", "who", 1.0, B.Settings(n_trees=4, depth=3))
    shares = B.importance(model)
    assert sum(shares.values()) == pytest.approx(1.0) and shares["f4"] == shares["f2"] == 0.0
    inner = model.feature == 0
    assert shares["f0"] / shares["f3"] == pytest.approx(model.gain[inner].mean() / model.gain[model.feature == 3].mean())


def test_rows_of_bins_descend_as_they_walk():
    rng = np.random.default_rng(3)
    depth, codes = 4, rng.integers(0, 256, (5, 3000)).astype(np.uint8)
    feature, cut, missing_left = rng.integers(-1, 5, 31), rng.integers(0, 255, 31), rng.random(31) < 0.5
    feature[0], feature[15:] = 2, -1
    for place in range(1, 15):  # nothing is below a leaf
        if feature[(place - 1) // 2] < 0:
            feature[place] = -1
    tables, descend = B.descent_function()
    place = B.walk_function()(codes.T, codes.T == 255, feature, cut, missing_left, depth)
    while (place < 15).any():  # a leaf further up stands at the end of its left side
        place = np.where(place < 15, 2 * place + 1, place)
    assert np.array_equal(descend(codes, tables(feature, cut, missing_left, depth)) + 15, place)


def test_rows_below_one_block_are_spread_over_tasks(spark, data, monkeypatch):
    tasks = []
    read = B._Grower._read
    monkeypatch.setattr(B, "SMALL_BLOCK_ROWS", 200)
    monkeypatch.setattr(B._Grower, "_read", lambda self, path: (read(self, path), tasks.append(self.n_tasks)))
    B.fit(data[0], NAMES, "y", "who", 1.0, B.Settings(n_trees=1, depth=1))
    assert tasks == [4]
