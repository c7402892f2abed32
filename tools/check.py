"""Compare every registered query with its SQL counterpart: python tools/check.py [sf_dir] [prefix...]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from paytally.plans.catalog import oracle_sql, queries  # noqa: E402
from paytally.plans.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def key(row):
        return tuple((v is None, str(v)) for v in row)

    return sorted((tuple(r[i] for i in order) for r in rows), key=key)


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return type(a) is type(b) and a == b


def compare(spark, con, name, query, statement, sf_dir):
    start = time.time()
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if statement is None:
        return f"rows-only {len(rows)}", took, True
    result = con.execute(statement)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS spark={sorted(df.columns)} sql={sorted(names)}", took, False
    got, want = rows_of(df.columns, rows), rows_of(names, expected)
    if len(got) != len(want):
        return f"ROWS spark={len(got)} sql={len(want)}", took, False
    for g, w in zip(got, want):
        if not all(same(x, y) for x, y in zip(g, w)):
            return f"VALUES {sorted(names)}\n   spark={g}\n   sql  ={w}", took, False
    return f"ok {len(got)} rows", took, True


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = local_session(8, "check")
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle, bad, total = connect(sf_dir), oracle_sql(), [], 0.0
    for name, query in queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            note, took, fine = compare(spark, con, name, query, oracle.get(name), sf_dir)
        except Exception as error:  # report and go on
            note, took, fine = f"ERROR {type(error).__name__}: {str(error)[:1500]}", 0.0, False
        total += took
        print(f"{'  ' if fine else '!!'} {name:38s} {took:6.2f}s {note}", flush=True)
        if not fine:
            bad.append(name)
    print(f"{len(bad)} failing of {len(queries())}: {bad}; spark time {total:.1f}s")


if __name__ == "__main__":
    main()
