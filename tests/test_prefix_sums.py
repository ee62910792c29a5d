"""Running sums against a plain loop, with keys over many tasks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from retenta.operators.prefix_sums import running_sums


def expected(rows, descending=False):
    total, out = {}, []
    for key, at, n, m in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", -r[1] if descending else r[1])):
        a, b = total.get(key, (0, 0))
        total[key] = (a + n, b + m)
        out.append((key, at, n, m, *total[key]))
    return sorted(out, key=str)


@pytest.mark.parametrize("partitions", [1, 3, 40])
@pytest.mark.parametrize("descending", [False, True])
def test_sums_of_skewed_keys(spark, partitions, descending):
    rng = random.Random(partitions)
    keys = ["hot"] * 6 + ["a", "b", None]
    rows = [(rng.choice(keys), at, rng.randrange(9), -at) for at in range(400)]
    df = spark.createDataFrame(rows, "key string, at bigint, n bigint, m bigint").repartition(5)
    order = [F.desc("at") if descending else "at"]
    found = running_sums(df, ["key"], order, ["n", "m"], partitions=partitions).collect()
    assert sorted((tuple(r) for r in found), key=str) == expected(rows, descending)


def test_without_keys_and_with_several(spark):
    rows = [(i % 2, str(i % 3), i, 1) for i in range(100)]
    df = spark.createDataFrame(rows, "a int, b string, at bigint, n bigint")
    found = {r["at"]: r["n_upto"] for r in running_sums(df, [], ["at"], ["n"], partitions=7).collect()}
    assert found == {i: i + 1 for i in range(100)}
    found = {r["at"]: r["n_upto"] for r in running_sums(df, ["a", "b"], ["at"], ["n"], partitions=9).collect()}
    assert found == {i: i // 6 + 1 for i in range(100)}


@pytest.mark.parametrize("partitions", [1, 50])
def test_previous_row_over_tasks(spark, partitions):
    rows = [("a" if i < 90 else "b", i, str(i) if i % 7 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "key string, at bigint, name string").repartition(6)
    found = running_sums(df, ["key"], ["at"], [], ["at", "name"], partitions).collect()
    got = {r["at"]: (r["at_previous"], r["name_previous"]) for r in found}
    want = {i: (None, None) if i in (0, 90) else (i - 1, rows[i - 1][2]) for i in range(100)}
    assert got == want


def test_empty(spark):
    df = spark.createDataFrame([], "key string, at bigint, n bigint")
    found = running_sums(df, ["key"], ["at"], ["n"])
    assert found.columns == ["key", "at", "n", "n_upto"] and found.collect() == []
