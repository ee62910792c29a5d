"""Distinct strings of a corpus: counted in tasks first, and the frequent ones as a table of bounded size.

Strings are Arrow binary arrays cut out of text buffers, so that equality is always of bytes.
A string of more than ``KEY_BYTES`` bytes is named by its SHA-256 behind a byte that no UTF-8
text holds, so every key is short and a table of ``n`` keys has a known largest size.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retenta.llm import text as T

KEY_BYTES = 64
#: Keys that a task holds before it hands them on; at most about 70 bytes each.
HELD_KEYS = 1_000_000
#: Bins of a frequency are a sixteenth of a doubling wide.
BINS_PER_DOUBLING = 16


def cut(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.BinaryArray:
    """The parts of ``data`` from each start to its end, which do not overlap and are in order."""
    step = np.zeros(len(data) + 1, np.int8)
    step[start] += 1
    step[end] -= 1
    inside = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=offsets[1:])
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))]
    )


def long_ones(strings: pa.BinaryArray) -> np.ndarray:
    return np.flatnonzero(pc.binary_length(strings).to_numpy(zero_copy_only=False) > KEY_BYTES)


def digest(string: bytes) -> bytes:
    return b"\xff" + hashlib.sha256(string).digest()


def keys_of(strings: pa.BinaryArray) -> pa.BinaryArray:
    """The strings, long ones by their digest."""
    at = long_ones(strings)
    if not len(at):
        return strings
    mask = np.zeros(len(strings), bool)
    mask[at] = True
    return pc.replace_with_mask(strings, pa.array(mask), pa.array([digest(strings[i].as_py()) for i in at.tolist()], pa.binary()))


def added_up(parts: list[pa.Table], by: list[str]) -> pa.Table:
    """One row per key of all parts, with the sum of their ``n``."""
    whole = pa.concat_tables(parts).group_by(by, use_threads=False).aggregate([("n", "sum")])
    return whole.select([*by, "n_sum"]).rename_columns([*by, "n"])


def counted(parts: Iterable[pa.Table], by: list[str], held: int = HELD_KEYS) -> Iterator[pa.Table]:
    """Sums of ``n`` by key over as many parts as a task may hold at once."""
    own, rows = [], 0
    for part in parts:
        own.append(part)
        rows += len(part)
        if rows >= 2 * held:
            own = [added_up(own, by)]
            rows = len(own[0])
            if rows >= held:
                yield own[0]
                own, rows = [], 0
    if own:
        yield added_up(own, by)


def batches_of(table: pa.Table, rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    yield from table.combine_chunks().to_batches(max_chunksize=rows)


def frequency_bin(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double")) * BINS_PER_DOUBLING).cast("int")


def least_bin(counts: DataFrame, limit: int, size: Column | None = None) -> int:
    """The least bin of ``n`` from which on the rows' sizes (1 each if not given) add up to ``limit`` at most.

    The driver gets about a thousand numbers.
    """
    own = F.lit(1) if size is None else size
    sizes = counts.groupBy(frequency_bin(F.col("n")).alias("bin")).agg(F.sum(own).alias("size")).collect()
    total, least = 0, None
    for row in sorted(sizes, key=lambda r: -r["bin"]):
        total += row["size"]
        if total > limit:
            break
        least = row["bin"]
    return least if least is not None else 1 << 30


class SharedTable(NamedTuple):
    """A table of bounded size that every worker can read, under a name of its own."""

    name: str
    arrow: Broadcast


def shared_table(rows: DataFrame) -> SharedTable:
    table, sink = rows.toArrow(), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return SharedTable(uuid.uuid4().hex, rows.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes()))


def read_shared(shared: SharedTable) -> pa.Table:
    """The table, read once per worker; the last one read is kept."""
    store = T.worker_store()
    held = store.get("shared table")
    if held is None or held[0] != shared.name:
        held = store["shared table"] = (shared.name, pa.ipc.open_stream(shared.arrow.value).read_all().combine_chunks())
    return held[1]


T.ship_by_value(__name__)
