"""Exact Shapley attributions of the boosted trees, for every row.

A leaf is a box: for each feature on its path, an interval and the share of training
weight that its splits pass on. Given a set of known features, the leaf's expected
contribution is its value times, per path feature, 'inside the interval' when known and
the share when not. Such a product over at most ``maxDepth`` features has exact Shapley
values that depend on the row only through which intervals hold it, so each leaf becomes
a table with one line per pattern. Scoring a batch is comparisons and look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import factorial
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retenta.operators import boosted_trees
from retenta.operators.boosted_trees import BoostedTrees


class LeafGame(NamedTuple):
    """A leaf's path features with the interval each must lie in, whether a missing value passes, and the table."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    missing: np.ndarray
    table: np.ndarray


def _leaf_table(value: float, shares: list[float]) -> np.ndarray:
    """Shapley values per pattern; bit k of a pattern says interval k holds the row."""
    d = len(shares)
    inside = (np.arange(2**d)[:, None] >> np.arange(d)) & 1
    table = np.zeros((2**d, d))
    for k in range(d):
        others = [j for j in range(d) if j != k]
        for size in range(d):
            weight = factorial(size) * factorial(d - size - 1) / factorial(d)
            for known in combinations(others, size):
                product = np.full(2**d, value)
                for j in others:
                    product = product * (inside[:, j] if j in known else shares[j])
                table[:, k] += weight * product * (inside[:, k] - shares[k])
    return table


def _leaf_games(model: BoostedTrees, tree: int) -> tuple[float, list[LeafGame]]:
    base, games = 0.0, []
    pending: list[tuple[int, dict]] = [(0, {})]
    while pending:
        place, path = pending.pop()
        feature = int(model.feature[tree, place])
        if feature < 0:
            value = float(model.value[tree, place])
            shares = [share for *_, share in path.values()]
            base += value * float(np.prod(shares))
            if path:
                low, high, missing, _ = (np.array(part) for part in zip(*path.values()))
                games.append(LeafGame(np.array(list(path)), low, high, missing, _leaf_table(value, shares)))
            continue
        cut, missing_left = float(model.threshold[tree, place]), bool(model.missing_left[tree, place])
        low, high, missing, share = path.get(feature, (-np.inf, np.inf, True, 1.0))
        for child, bounds, passes in (
            (2 * place + 1, (low, min(high, cut)), missing_left),
            (2 * place + 2, (max(low, cut), high), not missing_left),
        ):
            passed = float(model.cover[tree, child] / model.cover[tree, place])
            pending.append((child, {**path, feature: (*bounds, missing and passes, share * passed)}))
    return base, games


def leaf_games(model: BoostedTrees) -> tuple[float, list[LeafGame]]:
    """Base value and leaf tables, in log-odds."""
    base, games = 0.0, []
    for tree in range(model.n_trees):
        tree_base, tree_games = _leaf_games(model, tree)
        base += tree_base
        games += tree_games
    return base, games


def feature_attribution(model: BoostedTrees, rows: DataFrame) -> DataFrame:
    """Per person: ``base_value``, one ``phi_<feature>`` each, and the ``log_odds``.

    For every row the base value and the attributions add up to the log-odds.
    """
    base, games = leaf_games(model)
    # Plain tuples, so that workers need no copy of this library to read them.
    shared = rows.sparkSession.sparkContext.broadcast([tuple(game) for game in games])
    names = list(model.features)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[names].to_numpy(dtype=float)
            unknown = np.isnan(x)
            phi = np.zeros(x.shape)
            for features, low, high, missing, table in shared.value:
                chosen = x[:, features]
                inside = np.where(unknown[:, features], missing, (chosen > low) & (chosen <= high))
                phi[:, features] += table[inside @ (1 << np.arange(len(features)))]
            out = batch[["customer_unique_id"]].assign(base_value=base)
            for k, name in enumerate(names):
                out[f"phi_{name}"] = phi[:, k]
            yield out.assign(log_odds=batch["log_odds"])

    picked = boosted_trees.margins(model, rows.select("customer_unique_id", *names), "log_odds")
    picked = picked.select("customer_unique_id", *[F.col(name).cast("double").alias(name) for name in names], "log_odds")
    id_type = picked.schema["customer_unique_id"].dataType.simpleString()
    doubles = ["base_value", *(f"phi_{name}" for name in names), "log_odds"]
    schema = f"customer_unique_id {id_type}, " + ", ".join(f"{name} double" for name in doubles)
    return picked.mapInPandas(explain, schema)
