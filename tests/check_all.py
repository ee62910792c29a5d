"""Run registered queries against their SQL: ``python -m tests.check_all [sf_dir] [names]``."""

from __future__ import annotations

import sys
import time

import __spark_entry__ as entry
from retenta.session import build_session
from tests.compare import connect, differences


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(
        "check", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g", spark__ui__enabled="false"
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf_dir), entry.oracle_sql()
    only = sys.argv[2:]
    bad = 0
    for name, query in entry.queries().items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            frame = query(spark, sf_dir)
            if name in sql:
                found = differences(frame, con, sql[name])
            else:
                found = [] if frame.count() else ["no rows"]
                print("   ", frame.limit(2).collect())
        except Exception as error:  # noqa: BLE001
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(found)
        print(f"{'BAD ' if found else 'ok  '} {name} {time.time() - start:.1f}s", *found, sep="\n  " if found else " ", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
