"""Compare registered queries with their DuckDB SQL: schema, row count and values.

Command line: ``python tests/oracle.py [--sf 0.01] [name ...]``.
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()
KINDS = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
    "timestamp": "TIMESTAMP",
}


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def cell(value) -> str:
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return repr(value)


def compare(df, con, sql: str, rows=None) -> str | None:
    """None when both sides agree, else what differs."""
    rows = df.collect() if rows is None else rows
    names = sorted(df.columns)
    relation = con.sql(sql)
    theirs = dict(zip(relation.columns, (str(t) for t in relation.types)))
    if sorted(theirs) != names:
        return f"columns {names} against {sorted(theirs)}"
    ours = {c: KINDS.get(t, t) for c, t in df.dtypes}
    wrong = {c: (ours[c], theirs[c]) for c in names if ours[c] != theirs[c]}
    if wrong:
        return f"types {wrong}"
    order = [relation.columns.index(c) for c in names]
    a = sorted(tuple(cell(r[c]) for c in names) for r in rows)
    b = sorted(tuple(cell(r[i]) for i in order) for r in relation.fetchall())
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}" if bad else None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"

    import __spark_entry__ as entry
    from riverspark.session import build_session

    spark = build_session("oracle", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in args.names or queries:
        began = time.time()
        try:
            df = queries[name](spark, folder)
            rows = df.collect()
            took = time.time() - began
            verdict = compare(df, con, oracles[name], rows) if name in oracles else "rows only"
        except Exception as error:
            took = time.time() - began
            verdict = f"ERROR {str(error)[:1500]}"
            if args.names:
                traceback.print_exc()
            rows = []
        good = verdict in (None, "rows only")
        failed += not good
        print(f"{'ok  ' if good else 'FAIL'} {name} {took:.2f}s {len(rows)} rows {verdict or ''}", flush=True)
    print("failed", failed)
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main())
