"""Token ids as ORC files: integer run lengths, row indexes, and Bloom filters on document ids.

Files are in ascending order of document: Spark deals rows out by ranges of the id, each
task sorts and encodes its range and writes one file, so file k holds smaller ids than file
k + 1. Stripes can be read in parallel; a look-up by id skips files and stripes by their
least and greatest id and row groups by Bloom filter.

Nulls and ties: a null text is an empty one; a null id sorts first; rows of equal id are
ordered by the hash of their text, and equal rows stay as they are, one entry each. An empty
table gives files without rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retenta.llm import text as T
from retenta.llm import tokens as K

FILE_SCHEMA = "doc_id bigint, n_tokens bigint, part int, start_in_part bigint, ids array<int>"
#: Offsets are broadcast up to so many files, and joined as a table beyond.
BROADCAST_FILES = 1_000_000
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.stripe.size": str(64 << 20),
    "orc.row.index.stride": "1000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.dictionary.key.threshold": "0",
}


def token_rows(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of the files: ids of each text with ``end_id``, and where they start among those of their partition."""

    def encode(batches):
        encoder, part, at = K.encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = T.buffers(batch.column(1))
            for first, last in T.row_chunks(offsets):
                ids, counts = encoder.encode(data, offsets, first, last)
                ids = np.insert(ids, np.cumsum(counts), end_id)
                counts = counts + 1
                ends = np.cumsum(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array(counts),
                        pa.array(np.full(last - first, part, np.int32)),
                        pa.array(at + ends - counts),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids)),
                    ],
                    names=["doc_id", "n_tokens", "part", "start_in_part", "ids"],
                )
                at += int(ends[-1])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        encode, FILE_SCHEMA
    )


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Write the ids of all documents under ``path``, which the caller owns."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ranged = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    token_rows(ranged, tokenizer, end_id).write.options(**ORC_OPTIONS).orc(path)


def read_token_files(spark: SparkSession, path: str, wanted: Column | None = None) -> DataFrame:
    """Documents of the files with the number of ids before each; ``wanted`` (on doc_id) prunes before reading."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row a file, so that this window is as small as the list of files.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    if len(rows.inputFiles()) <= BROADCAST_FILES:
        offsets = F.broadcast(offsets)
    if wanted is not None:
        rows = rows.filter(wanted)
    return rows.join(offsets, "part").select(
        "doc_id", (F.col("start_in_part") + F.col("before")).alias("start"), "n_tokens", "ids"
    )


def with_crc32(rows: DataFrame, ids_col: str = "ids") -> DataFrame:
    """Replace the ids by the unsigned CRC-32 of them as little-endian 32-bit integers (``ids_crc32``)."""
    kept = [name for name in rows.columns if name != ids_col]

    def digest(batch: pa.RecordBatch):
        lists = batch.column(len(kept))
        values, offsets = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
        raw = memoryview(values.tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(len(kept))), pa.array(crc, pa.int64())], names=[*kept, "ids_crc32"]
        )

    schema = ", ".join(f"`{name}` {rows.schema[name].dataType.simpleString()}" for name in kept)
    return T.map_batches(rows.select(*kept, ids_col), f"{schema}, ids_crc32 bigint", digest)


T.ship_by_value(__name__)
