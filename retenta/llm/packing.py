"""Packing of token ids into windows of one size by best-fit decreasing.

Overlong documents are first cut into full windows, each a sequence of its own. The
remaining pieces are placed longest first, each into the open window that it fits most
tightly; a segment tree over remaining capacities finds that window. Pieces are packed where
they were tokenized, block by block, so ids are never shuffled and a task holds one block.
Each block leaves at most a few windows open, and its size makes their padding negligible.

Nulls and ties: a null text is an empty document, which is its end id alone; rows of equal id
or equal text are packed each for itself; a null id is kept. An empty table gives no pieces.
Other columns of the input are ignored. Pieces of equal length go in order of the rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retenta.llm import text as T
from retenta.llm import tokens as K

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
)
#: Ids in one block; at 2048 to a window some 3,000 windows are filled together.
BLOCK_IDS = 6_000_000
#: Pieces handed on at once; with their ids they are 4 MB at most.
OUT_ROWS = 500


class OpenWindows:
    """Open windows by what they can still take, in a segment tree of counts with one leaf per capacity."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        node = self.leaves + capacity
        while node:
            self.tree[node] += 1
            node >>= 1

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, window) of the least capacity that is at least ``need``."""
        node, tree = self.leaves + need, self.tree
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node == 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        while node:
            tree[node] -= 1
            node >>= 1
        return capacity, self.windows[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece; no piece may be longer than ``size``."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_windows, n = OpenWindows(size), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = open_windows.take_tightest(need)
        if found is None:
            capacity, at = size, n
            n += 1
        else:
            capacity, at = found
        window[i], offset[i] = at, size - capacity
        if capacity > need:
            open_windows.add(capacity - need, at)
    return window, offset


def placed(ids: np.ndarray, source: np.ndarray, target: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """``n`` ids with each piece at its target, copied piece by piece: indexes of single ids would be several times the block."""
    out = np.zeros(n, "<i4")
    for a, b, k in zip(source.tolist(), target.tolist(), length.tolist()):
        out[b : b + k] = ids[a : a + k]
    return out


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    size: int = 2048,
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: the document, where the piece starts in its ids, its place in a sequence, a checksum
    read back from the packed sequence, and the ids themselves unless ``with_ids`` is off."""

    def blocks(batches):
        """Documents of one block: their ids, and the ids of all of them in a row."""
        encoder = K.encoder(tokenizer)
        docs_in, counts_in, ids_in, held = [], [], [], 0
        for batch in batches:
            data, offsets = T.buffers(batch.column(1))
            for first, last in T.row_chunks(offsets):
                ids, counts = encoder.encode(data, offsets, first, last)
                ids_in.append(np.insert(ids, np.cumsum(counts), end_id).astype("<i4"))
                counts_in.append(counts + 1)
                docs_in.append(batch.column(0).slice(first, last - first))
                held += len(ids_in[-1])
                if held >= BLOCK_IDS:
                    yield pa.concat_arrays(docs_in), np.concatenate(counts_in), np.concatenate(ids_in)
                    docs_in, counts_in, ids_in, held = [], [], [], 0
        if docs_in:
            yield pa.concat_arrays(docs_in), np.concatenate(counts_in), np.concatenate(ids_in)

    def run(batches):
        next_id = TaskContext.get().partitionId() << 40
        for doc_ids, counts, ids in blocks(batches):
            per_doc = -(-counts // size)
            doc = np.repeat(np.arange(len(counts)), per_doc)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
            start = nth * size
            length = np.minimum(counts[doc] - start, size)
            window, offset = best_fit_decreasing(length, size)
            n = int(window.max()) + 1
            source, target = (np.cumsum(counts) - counts)[doc] + start, window * size + offset
            packed = placed(ids, source, target, length, n * size)
            del ids
            raw, low = memoryview(packed).cast("B"), 4 * target
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(low.tolist(), (low + 4 * length).tolist())]
            columns = [doc_ids.take(pa.array(doc)), *map(pa.array, (start, length))]
            columns += [pa.array(crc, pa.int64()), *map(pa.array, (counts[doc], next_id + window, offset))]
            next_id += n
            for a in range(0, len(doc), OUT_ROWS):
                rows = [column.slice(a, OUT_ROWS) for column in columns]
                if with_ids:
                    own = [packed[w : w + k] for w, k in zip(target[a : a + OUT_ROWS], length[a : a + OUT_ROWS])]
                    ends = np.concatenate([[0], np.cumsum(length[a : a + OUT_ROWS])])
                    rows.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(own))))
                yield pa.RecordBatch.from_arrays(rows, names=names)

    schema = SCHEMA + (", ids array<int>" if with_ids else "")
    names = [field.split()[0] for field in schema.split(", ")]
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, schema
    )


def sequences(pieces: DataFrame, size: int = 2048, pad_id: int = 0) -> DataFrame:
    """One row per sequence: its ids in order, padded to ``size`` unless their number is a power of two."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.flatten(F.transform(ordered, lambda piece: piece["ids"]))
    n = F.size("ids")
    padded = F.when(n.bitwiseAND(n - 1) == 0, F.col("ids")).otherwise(
        F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(size) - n))
    )
    return pieces.groupBy("sequence_id").agg(joined.alias("ids")).select(
        "sequence_id", n.cast("bigint").alias("length"), padded.alias("ids")
    )


T.ship_by_value(__name__)
