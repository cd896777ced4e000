"""Run registered queries next to their SQL in DuckDB and compare the values.

    python -m tests.oracle_check [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, [tuple(plain(r[c]) for c in names) for r in df.select(*[f"`{c}`" for c in names]).collect()]


def duck_rows(con, sql: str):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], [tuple(plain(r[i]) for i in order) for r in cursor.fetchall()]


def kind(value) -> str:
    return "float" if isinstance(value, float) else type(value).__name__


def compare(left, right) -> str | None:
    (lc, lr), (rc, rr) = left, right
    if lc != rc:
        return f"columns differ: {lc} != {rc}"
    if len(lr) != len(rr):
        return f"row counts differ: {len(lr)} != {len(rr)}"
    key = lambda row: tuple((v is not None, str(v)) for v in row)
    lr, rr = sorted(lr, key=key), sorted(rr, key=key)
    bad = [(a, b) for a, b in zip(lr, rr) if a != b or [kind(x) for x in a] != [kind(x) for x in b]]
    if bad:
        return f"{len(bad)} of {len(lr)} rows differ, first:\n   spark {bad[0][0]}\n   sql   {bad[0][1]}"
    return None


def main() -> int:
    from strideframe.session import build_session
    from workload import ORACLES, QUERIES

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    failures = 0
    for name in args.names or QUERIES:
        start = time.time()
        try:
            left = spark_rows(QUERIES[name](spark, args.sf))
            middle = time.time()
            note = f"{len(left[1])} rows"
            problem = None
            if name in ORACLES:
                problem = compare(left, duck_rows(con, ORACLES[name]))
            else:
                note += " (rows only)"
            print(f"{'FAIL' if problem else 'ok  '} {name}: {note}, spark {middle - start:.1f}s, sql "
                  f"{time.time() - middle:.1f}s", flush=True)
        except Exception as error:  # keep going: the list of failures is the result
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
            print(f"FAIL {name}", flush=True)
        if problem:
            failures += 1
            print("  ", problem, flush=True)
    print(f"{failures} failures")
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main())
