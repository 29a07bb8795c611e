"""Runs registered queries on Spark and their SQL on DuckDB and compares the rows.

    python -m verification.compare [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = [p for p in (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()]


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return str(value)
    if isinstance(value, float):
        return repr(value)
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql: str) -> list[str]:
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    expected = rows_of(names, answer.fetchall())
    found = rows_of(spark_df.columns, spark_df.collect())
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns differ: {sorted(set(names) ^ set(spark_df.columns))}"]
    if expected == found:
        return []
    missing, extra = expected - found, found - expected
    return [
        f"{sum(found.values())} rows against {sum(expected.values())}; "
        f"{sum(missing.values())} missing, {sum(extra.values())} unexpected",
        f"columns    {sorted(names)}",
        *[f"missing    {r}" for r in sorted(missing, key=str)[:2]],
        *[f"unexpected {r}" for r in sorted(extra, key=str)[:2]],
    ]


def main() -> int:
    from tenderlake.session import build_session
    from verification.oracle_queries import ORACLE
    from verification.registry import QUERIES

    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    args = parser.parse_args()
    spark = build_session(
        "compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    bad = 0
    for name in args.names or QUERIES:
        start = time.time()
        try:
            found = QUERIES[name](spark, args.sf)
            problems = (
                differences(found, con, ORACLE[name]) if name in ORACLE else [f"rows only: {found.count()}"]
            )
        except Exception as e:  # report and go on with the next query
            problems = [f"{type(e).__name__}: {str(e)[:600]}"]
        failed = bool(problems) and not problems[0].startswith("rows only")
        bad += failed
        print(f"{'FAIL' if failed else 'ok  '} {name} {time.time() - start:.1f}s", *problems, sep="\n      ", flush=True)
    print(f"{bad} of {len(args.names or QUERIES)} differ")
    return bad


if __name__ == "__main__":
    sys.exit(main())
