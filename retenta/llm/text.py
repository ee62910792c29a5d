"""Words and hashes of whole texts, computed on Arrow buffers without a Python object per word.

A word is a run of bytes other than the six ASCII white-space characters. Word hashes are
64-bit polynomials over the word's bytes, so equal words have equal hashes in every task
of every job; names of longer runs of words are built from them the same way.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

WHITE = " \t\n\v\f\r"
CHUNK_BYTES = 1 << 21
_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD1342543DE82EF95
_BITS = (1 << 64) - 1


def ship_by_value(name: str) -> None:
    """Let functions of module ``name`` travel to executors whole: workers need no copy of this library."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def worker_store() -> dict:
    """What a Python worker keeps between its tasks (encoders, tables of powers)."""
    return sys.modules.setdefault("_llm_worker_store", types.ModuleType("_llm_worker_store")).__dict__


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, so that any bits of them can serve as a hash."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA5CB9243F8B7D6A1)
    return h ^ (h >> np.uint64(32))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd base and of its inverse, modulo 2**64."""
    store = worker_store()
    have = store.get(("powers", base))
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + (1 << 16))
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            row = np.full(size, b, np.uint64)
            row[0] = 1
            both.append(np.cumprod(row))
        have = store["powers", base] = tuple(both)
    return have


def byte_table(fold_case: bool = False, drop: bytes = b"") -> np.ndarray:
    """A random value for each byte; folded bytes share one, dropped bytes count as 0."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    if fold_case:
        values[65:91] = values[97:123]
    if drop:
        values[list(drop)] = 0
    return values


@dataclass
class Words:
    """The words of a run of rows: where each starts and ends in ``data``; ``of[i]:of[i+1]`` are those of row i."""

    data: np.ndarray
    rows: np.ndarray
    start: np.ndarray
    end: np.ndarray
    of: np.ndarray

    def hashes(self, table: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        up, down = _powers(_BASE, len(self.data) + 1)
        terms = table[self.data]
        terms *= up[: len(terms)]
        total = np.cumsum(terms)
        own = total[self.end - 1] - total[self.start] + terms[self.start]
        return mix(own * down[self.start])

    def texts(self, which: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.start[which].tolist(), self.end[which].tolist())]

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.of) - 1), np.diff(self.of))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, kind)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64)


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes; a longer row is a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def words_of(data: np.ndarray, offsets: np.ndarray, first: int, last: int, apart: str = WHITE) -> Words:
    """Words of rows ``first`` to ``last``: runs of anything but ``apart``, none over the end of its row."""
    low, high = int(offsets[first]), int(offsets[last])
    x = data[low:high]
    rows = offsets[first : last + 1] - low
    white = np.zeros(256, bool)
    white[[ord(c) for c in apart]] = True
    inside = ~white[x]
    cut = np.zeros(len(x) + 1, bool)
    cut[rows] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(x, rows, start, end, np.searchsorted(start, rows))


def windows(hashes: np.ndarray, of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``size`` words in a row that lie in one row, and where each starts, in order."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if size <= 8:
        total = hashes[:n].copy()
        for k in range(1, size):
            total *= np.uint64(_WORD_BASE)
            total += hashes[k : n + k]
    else:
        up, down = _powers(_WORD_BASE, len(hashes) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)])])
        total = (sums[size:] - sums[:-size]) * down[:n]
    within = np.repeat(of[1:], np.diff(of))[:n]
    at = np.flatnonzero(np.arange(n) + size <= within)
    return mix(total[at]), at


def map_batches(df: DataFrame, schema: StructType | str, run: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]) -> DataFrame:
    """``mapInArrow`` with a function of one batch."""

    def each(batches):
        for batch in batches:
            yield from run(batch)

    return df.mapInArrow(each, schema)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file, as installed on driver and workers alike."""
    import public_tokenizers

    return str(Path(public_tokenizers.path(name)))


ship_by_value(__name__)
