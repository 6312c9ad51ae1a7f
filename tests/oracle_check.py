"""Run registered queries against their checking SQL: ``python tests/oracle_check.py [sf] [name-prefix …]``."""

from __future__ import annotations

import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, decimal.Decimal):
        return f"DECIMAL {value}"
    if isinstance(value, float):
        return "NULL" if math.isnan(value) else repr(value)
    return f"{type(value).__name__ if not isinstance(value, (int, str)) else ''}{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, sql, con):
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    other, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if names != other:
        return len(got), f"columns {names} != {other}"
    if got != want:
        a, b = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
        return len(got), f"rows {len(got)} vs {len(want)}\n   spark {a}\n   duck  {b}"
    return len(got), None


def connect(folder):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def main():
    import __spark_entry__ as entry
    from signalloom.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    prefixes = sys.argv[2:]
    folder = f"/root/testdata/{sf}"
    spark = build_session("check", "local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8", spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in oracles:
                n, problem = compare(df, oracles[name], con)
            else:
                n, problem = len(df.collect()), None
        except Exception as error:  # noqa: BLE001
            n, problem = -1, f"{type(error).__name__}: {str(error)[:900]}"
        bad += problem is not None
        mark = "FAIL" if problem else ("ok  " if name in oracles else "rows")
        print(f"{mark} {name} rows={n} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failures:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
