"""Exact order statistics of many columns without a sort or a shuffle of the values.

A double becomes a 64-bit number of the same order. In four passes over the rows, tasks count how
many values begin with which 16 bits, first over all and then only behind the prefixes in which a
wanted rank lies; each pass narrows all ranks of all columns by 16 bits at once. The driver gets at
most 65,536 counts per column and prefix, and there are at most two prefixes per quantile.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS, DIGIT_BITS = 4, 16


def _counts(rows: DataFrame, columns: list[str], known: list[list[int]], digit: int) -> list[dict[int, np.ndarray]]:
    """For each column and known prefix of ``digit`` digits, how many values go on with which digit."""
    prefixes = [np.array(sorted(set(own)), np.uint64) for own in known]
    shift = np.uint64(64 - DIGIT_BITS * (digit + 1))

    def count(batches):
        totals = [np.zeros((len(own), 1 << 16), np.int64) for own in prefixes]
        for batch in batches:
            for column, own, total in zip(batch.columns, prefixes, totals):
                x = column.to_numpy(zero_copy_only=False).astype(np.float64)
                x = x[~np.isnan(x)] + 0.0  # there is one zero
                bits = x.view(np.int64)
                keys = (bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.uint64) ^ np.uint64(1 << 63)
                if digit:
                    before = keys >> (shift + np.uint64(16))
                    at = np.searchsorted(own, before)
                    inside = (at < len(own)) & (own[np.minimum(at, len(own) - 1)] == before) if len(own) else np.zeros(len(keys), bool)
                    at, keys = at[inside], keys[inside]
                else:
                    at = np.zeros(len(keys), np.int64)
                cell = at * 65536 + ((keys >> shift) & np.uint64(0xFFFF)).astype(np.int64)
                total += np.bincount(cell, minlength=total.size).reshape(total.shape)
        for k, total in enumerate(totals):
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), k, np.int32)), pa.array(at), pa.array(total.ravel()[at])], names=["k", "cell", "n"]
            )

    found = rows.select(*columns).mapInArrow(count, "k int, cell bigint, n bigint")
    table = found.groupBy("k", "cell").agg(F.sum("n").alias("n")).toArrow()
    k, cell, n = (table.column(name).to_numpy() for name in ("k", "cell", "n"))
    out = []
    for i, own in enumerate(prefixes):
        whole = np.zeros((len(own), 1 << 16), np.int64)
        whole.ravel()[cell[k == i]] = n[k == i]
        out.append(dict(zip(own.tolist(), whole)))
    return out


def _double(key: int) -> float:
    bits = np.array([key ^ (1 << 63)], np.uint64).view(np.int64)
    return float((bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(np.float64)[0])


def exact_quantiles(rows: DataFrame, columns: list[str], probabilities: list[float]) -> dict[str, list[float | None]]:
    """The quantiles of each column, linear between neighbours; nulls and NaN are left out, none at all gives None.

    Give a written frame of double columns: it is read four times.
    """
    wanted: list[dict[int, tuple[int, int]]] = []  # per column: rank -> (prefix, rank within it)
    counts = _counts(rows, columns, [[0]] * len(columns), 0)
    sizes = [int(own[0].sum()) for own in counts]
    places = [[(n - 1) * p for p in probabilities] for n in sizes]
    for n, own in zip(sizes, places):
        ranks = {r for at in own for r in (math.floor(at), math.ceil(at))} if n else set()
        wanted.append({r: (0, r) for r in ranks})
    for digit in range(DIGITS):
        if digit:
            counts = _counts(rows, columns, [[prefix for prefix, _ in own.values()] for own in wanted], digit)
        for own, found in zip(wanted, counts):
            upto = {prefix: np.cumsum(n) for prefix, n in found.items()}
            for rank, (prefix, within) in own.items():
                step = int(np.searchsorted(upto[prefix], within, "right"))
                before = int(upto[prefix][step - 1]) if step else 0
                own[rank] = (prefix << DIGIT_BITS | step, within - before)
    out = {}
    for column, own, at in zip(columns, wanted, places):
        value = {rank: _double(key) for rank, (key, _) in own.items()}
        out[column] = [_between(value[math.floor(x)], value[math.ceil(x)], x - math.floor(x)) if own else None for x in at]
    return out


def _between(low: float, high: float, share: float) -> float:
    return low + (high - low) * share if share else low
