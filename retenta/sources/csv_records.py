"""One large CSV file with line breaks inside of quotes, read by many tasks.

A reader that starts somewhere in a file cannot tell a line break in a text from the end of a
record, so Spark's multi-line mode gives a file to one task. Here byte ranges are read as lines:

1. quotes are counted per range. Before a range stands an odd number of them exactly if it begins
   inside of quotes; running sums over the ranges tell;
2. every range then goes from its first record border to its last by itself, and its records are
   parsed by Spark's own CSV rules. What is left at both ends are parts of records that lie in
   several ranges, two per range at most; these are put together and parsed as well.

A quote inside of a quoted field is doubled, and a field that isn't quoted holds no quote: a file
whose quotes do not pair up stops the job. Records end with a line feed, or carriage return and
line feed. In a file whose first line ends with both, both within quotes become a line feed, as
Spark's own reader has it; other line breaks within quotes stay as they are. Files are UTF-8. The first record of each
file is its header and goes; empty lines go, too. A record is put together in one task's memory.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from retenta.operators.prefix_sums import running_sums
from retenta.session import stage

#: Ranges up to which their table is broadcast; at 128 MB each that is 100 TB.
MOST_RANGES = 1_000_000
WHOLE, HEAD, TAIL = 0, 1, 2


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, file, start): the lines of each byte range in order, as bytes."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("value").cast("binary").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
    )


def ranges(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, inside, crlf): whether each byte range that has lines begins inside of quotes, and how the file's
    first line ends."""
    value = F.col("value")
    quotes = F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        quotes.cast("bigint").alias("quotes"), F.endswith(value, F.lit("\r")).alias("crlf"), F.monotonically_increasing_id().alias("at"),
    )
    by_range = lines.groupBy("file", "start").agg(F.sum("quotes").alias("quotes"), F.min_by("crlf", "at").alias("crlf"))
    counted = running_sums(by_range, ["file"], ["start"], ["quotes"])
    odd = counted.groupBy("file").agg(F.sum("quotes").alias("total")).filter("total % 2 = 1").first()
    if odd:
        raise ValueError(f"the quotes of {odd['file']} do not pair up")
    first = counted.filter("start = 0").select("file", "crlf")
    inside = counted.select("file", "start", ((F.col("quotes_upto") - F.col("quotes")) % 2 == 1).alias("inside"))
    return inside.join(first, "file")


def _record_parts(lines: DataFrame, kinds: tuple[int, ...]) -> DataFrame:
    """(file, start, crlf, kind, first, text): records that lie in their range, and parts of others, of the kinds asked for.

    ``lines`` have ``inside``, whether their range begins inside of quotes; ``first`` marks a file's first record.
    """
    whole_kind, head_kind, tail_kind = WHOLE, HEAD, TAIL

    def run(batches):
        at, held, opened, first, begun = None, [], False, False, False

        def part(closed: bool):
            """What is held, as a record or a part of one; a record that is an empty line is none."""
            kind = head_kind if not begun else whole_kind if closed else tail_kind
            empty = kind == whole_kind and held in ([b""], [b"\r"])
            return None if empty or kind not in kinds else (*at, kind, first, b"\n".join(held))

        for batch in batches:
            out = []
            odd = pc.bit_wise_and(pc.count_substring(batch.column(0), '"'), 1).to_pylist()
            for line, file, start, inside, crlf, flips in zip(*(c.to_pylist() for c in batch.columns), odd):
                if at != (file, start, crlf):
                    if held:
                        out.append(part(not opened))
                    at, held, opened = (file, start, crlf), [], inside
                    begun, first = not inside, start == 0
                held.append(line)
                opened ^= bool(flips)
                if not opened:
                    out.append(part(True))
                    # An empty first line is not the header.
                    first = first and held in ([b""], [b"\r"])
                    held, begun = [], True
            rows = [row for row in out if row]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        if held and (row := part(not opened)):
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)

    names = ["file", "start", "crlf", "kind", "first", "text"]
    types = [pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.bool_(), pa.binary()]
    schema = "file string, start bigint, crlf boolean, kind int, first boolean, text binary"
    return lines.select("line", "file", "start", "inside", "crlf").mapInArrow(run, schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record): every record of the files under ``path`` but their headers."""
    known = stage(ranges(spark, path), "csv-ranges")
    if known.count() <= MOST_RANGES:
        known = F.broadcast(known)
    lines = _lines(spark, path).join(known, ["file", "start"])
    parts = stage(_record_parts(lines, (HEAD, TAIL)), "csv-parts")
    # A record begins with the tail of a range and goes on with the heads of those after it.
    numbered = parts.withColumn("begins", (F.col("kind") == TAIL).cast("bigint"))
    numbered = running_sums(numbered, ["file"], ["start", "kind"], ["begins"])
    pieces = F.sort_array(F.collect_list(F.struct("start", "kind", "text")))
    joined = F.array_join(F.transform(pieces, lambda p: p["text"].cast("string")), "\n")
    long = numbered.groupBy("file", "begins_upto", "crlf").agg(joined.alias("record"), F.bool_or("first").alias("first"))
    whole = _record_parts(lines, (WHOLE,)).select(F.col("text").cast("string").alias("record"), "first", "crlf")
    both = whole.unionByName(long.select("record", "first", "crlf")).filter(~F.col("first"))
    ended = F.regexp_replace("record", r"\r\z", "")
    return both.select(F.when(F.col("crlf"), F.replace(ended, F.lit("\r\n"), F.lit("\n"))).otherwise(ended).alias("record"))


def read_multiline_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """As Spark's CSV reader with a header and ``multiLine``, by as many tasks as the file has ranges."""
    options = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "FAILFAST"}
    parsed = F.from_csv("record", schema.simpleString()[len("struct<") : -1].replace(":", " "), options)
    return read_records(spark, path).select(parsed.alias("row")).select("row.*")
