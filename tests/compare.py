"""Compare a Spark result with a DuckDB result: columns, types, rows as a multiset."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value


def _rows(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty when both agree exactly; else what differs, with a few rows of each side."""
    relation = con.sql(sql)
    want_types = dict(zip(relation.columns, map(str, relation.types)))
    have_types = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in spark_df.schema}
    found = []
    if set(want_types) != set(have_types):
        return [f"columns {sorted(have_types)} != {sorted(want_types)}"]
    for name in want_types:
        if want_types[name] != have_types[name]:
            found.append(f"type of {name}: {have_types[name]} != {want_types[name]}")
    want = _rows(relation.columns, relation.fetchall())
    have = _rows(spark_df.columns, spark_df.collect())
    if want != have:
        only_have, only_want = have - want, want - have
        found.append(f"{sum(only_have.values())} rows only in Spark, {sum(only_want.values())} only in SQL")
        found += [f"  spark {row}" for row in list(sorted(only_have, key=str))[:2]]
        found += [f"  sql   {row}" for row in list(sorted(only_want, key=str))[:2]]
    return found
