"""What a task of packing holds, and which rows of near duplicates move with their texts."""

from __future__ import annotations

import tracemalloc

import numpy as np

from retenta.llm import neardup, packing
from retenta.session import stage


def test_placing_ids_takes_little_more_than_the_ids():
    rng = np.random.default_rng(1)
    length = rng.integers(1, 2049, 500)
    ids = rng.integers(0, 49_000, int(length.sum())).astype("<i4")
    window, offset = packing.best_fit_decreasing(length, 2048)
    source, target, n = np.cumsum(length) - length, window * 2048 + offset, 2048 * (int(window.max()) + 1)
    tracemalloc.start()
    packed = packing.placed(ids, source, target, length, n)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.2 * packed.nbytes
    for a, b, k in zip(source, target, length):
        assert np.array_equal(packed[b : b + k], ids[a : a + k])


def test_bit_map_lets_wanted_rows_through_and_few_others(spark):
    rows = [(i, f"text {i % 300} of many words in a row") for i in range(600)] + [(None, "text 7 of none"), (700, " "), (701, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    every = stage(neardup._rows(docs, "doc_id", "text", "text").fillna({"doc_id": neardup.NO_ID}))
    chosen = every.filter(f"doc_id < 100 OR doc_id = {neardup.NO_ID}").select("node", "doc_id")
    only = spark.sparkContext.broadcast(neardup._bit_map(chosen))
    got = [r["doc_id"] for r in neardup._rows(docs, "doc_id", "text", "text", only=only).collect()]
    assert {None, *range(100)} <= set(got) and len(got) <= 103
