"""Running sums over a global order, with as many tasks as the cluster shuffles into.

Rows are dealt out by ranges of the order and sorted within; every task adds up its own rows
and hands on its first and last row. From these, two per task, follows what the tasks before
hold of the key that a task begins with, and that is added to the rows of this key. A key may
hold any share of the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType

from retenta.session import stage

ROW, FIRST, LAST = 0, 1, 2


def _with_local_sums(rows: DataFrame, by: list[str], sums: list[str], previous: list[str]) -> DataFrame:
    """Rows with their task's running sums; the first and last row of a task come once more, marked so."""
    n_columns = len(rows.columns)
    key_at = [rows.columns.index(name) for name in by]
    sum_at = [rows.columns.index(name) for name in sums]
    previous_at = [rows.columns.index(name) for name in previous]
    added = [*(f"{name}_upto" for name in sums), *(f"{name}_previous" for name in previous)]
    names = [*rows.columns, *added, "_part", "_kind", "_one_key", "_head"]

    def differ(a: pa.Array, b: pa.Array) -> np.ndarray:
        unequal = pc.fill_null(pc.not_equal(a, b), False)
        return pc.or_(unequal, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)

    def run(batches):
        part, last, one_key = TaskContext.get().partitionId(), None, True
        carried = np.zeros(len(sum_at), np.int64)

        def out(columns: list, kind: int, head: bool = False) -> pa.RecordBatch:
            n = len(columns[0])
            marks = [pa.array(np.full(n, value, np.int32)) for value in (part, kind)]
            heads = np.zeros(n, bool)
            heads[0] = head
            return pa.RecordBatch.from_arrays([*columns, *marks, pa.array(np.full(n, one_key)), pa.array(heads)], names=names)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            for k in key_at:
                before = batch.column(k).slice(0, 1) if last is None else last[k]
                own = pa.concat_arrays([before, batch.column(k)])
                new |= differ(own.slice(0, n), own.slice(1))
            one_key = one_key and not new.any()
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            columns = [batch.column(k) for k in range(n_columns)]
            for j, k in enumerate(sum_at):
                total = np.concatenate([[0], np.cumsum(batch.column(k).to_numpy(zero_copy_only=False))])
                upto = total[1:] - total[np.maximum(start, 0)] + np.where(start < 0, carried[j], 0)
                carried[j] = upto[-1]
                columns.append(pa.array(upto.astype(np.int64)))
            for k in previous_at:
                own = batch.column(k)
                before = pa.nulls(1, own.type) if last is None else last[k]
                shifted = pa.concat_arrays([before, own.slice(0, n - 1)])
                columns.append(pc.if_else(pa.array(new), pa.scalar(None, own.type), shifted))
            head = last is None
            if head:
                yield out([c.slice(0, 1) for c in columns], FIRST)
            last = [c.slice(n - 1, 1) for c in columns]
            yield out(columns, ROW, head)
        if last is not None:
            yield out(last, LAST)

    schema = StructType(rows.schema.fields[:])
    for name in sums:
        schema = schema.add(StructField(f"{name}_upto", LongType()))
    for name in previous:
        schema = schema.add(StructField(f"{name}_previous", rows.schema[name].dataType))
    for name, kind in (("_part", IntegerType()), ("_kind", IntegerType()), ("_one_key", BooleanType()), ("_head", BooleanType())):
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema)


def running_sums(
    rows: DataFrame,
    by: list[str],
    order: list[str | Column],
    sums: list[str],
    previous: list[str] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Add ``<name>_upto`` for each integer column in ``sums``: its total over the rows of the same ``by``
    up to and including the row, in the order given; and ``<name>_previous`` for each column in ``previous``:
    its value in the row before, null in the first one.

    Rows that tie in the order may come in any order, but all columns go by the same one: it is that
    of a table written to the shared folder. Null keys are equal. The driver gets two rows per task.
    """
    spark, previous = rows.sparkSession, previous or []
    keys = [F.asc(name) for name in by] + [F.col(c).asc() if isinstance(c, str) else c for c in order]
    dealt = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    written = stage(_with_local_sums(dealt.sortWithinPartitions(*keys), by, sums, previous), "running-sums")
    ends: dict[int, dict] = {}
    for row in written.filter(F.col("_kind") != ROW).collect():
        ends.setdefault(row["_part"], {})[row["_kind"]] = row
    carried, key, totals, last = [], None, [0] * len(sums), None
    for part in sorted(ends):
        first = ends[part][FIRST]
        begins = tuple(first[name] for name in by)
        goes_on = key == begins
        carry = totals if goes_on else [0] * len(sums)
        carried.append((part, *begins, *carry, *(last[name] if goes_on else None for name in previous)))
        last = ends[part][LAST]
        key = tuple(last[name] for name in by)
        own = [last[f"{name}_upto"] for name in sums]
        totals = [a + b for a, b in zip(own, carry)] if last["_one_key"] else own
    schema = StructType([StructField("_part", IntegerType())])
    for i, name in enumerate(by):
        schema = schema.add(f"_first_{i}", rows.schema[name].dataType)
    for j in range(len(sums)):
        schema = schema.add(f"_before_{j}", LongType())
    for j, name in enumerate(previous):
        schema = schema.add(f"_last_{j}", rows.schema[name].dataType)
    same = F.lit(True)
    for i, name in enumerate(by):
        same = same & F.col(name).eqNullSafe(F.col(f"_first_{i}"))
    # One row per task of the shuffle: the broadcast does not grow with the rows.
    joined = written.filter(F.col("_kind") == ROW).join(F.broadcast(spark.createDataFrame(carried, schema)), "_part")

    def total(j: int, name: str) -> Column:
        return F.col(f"{name}_upto") + F.when(same, F.col(f"_before_{j}")).otherwise(F.lit(0).cast("bigint"))

    def before(j: int, name: str) -> Column:
        return F.when(F.col("_head"), F.col(f"_last_{j}")).otherwise(F.col(f"{name}_previous"))

    return joined.select(
        *rows.columns,
        *[total(j, name).alias(f"{name}_upto") for j, name in enumerate(sums)],
        *[before(j, name).alias(f"{name}_previous") for j, name in enumerate(previous)],
    )
