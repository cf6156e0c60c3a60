"""Runs registered queries on Spark and their SQL twin on DuckDB and compares the results.

usage: python tests/check_oracle.py [name-part ...]     (environment: SF_DIR)
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if value is None:
        return None
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, name, fn, sql):
    started = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spark_time = time.time() - started
    if sql is None:
        return f"ROWS   {name:32s} {len(got):7d} rows  {spark_time:6.2f}s"
    started = time.time()
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    duck_time = time.time() - started
    gc, gr = rows_of(df.columns, got)
    wc, wr = rows_of(want_cols, want)
    if gc != wc:
        return f"FAIL   {name:32s} columns {gc} != {wc}"
    if gr != wr:
        diff = [(a, b) for a, b in zip(gr, wr) if a != b][:3]
        out = f"FAIL   {name:32s} {len(gr)} vs {len(wr)} rows"
        for a, b in diff:
            out += f"\n   spark {str(a)[:700]}\n   duck  {str(b)[:700]}"
        return out
    return f"ok     {name:32s} {len(gr):7d} rows  {spark_time:6.2f}s  (duckdb {duck_time:.2f}s)"


def main(parts):
    from webquarry.session import build_session
    import __spark_entry__ as entry

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        try:
            line = compare(spark, con, sf_dir, name, fn, oracle.get(name))
        except Exception as error:  # report and go on with the next query
            line = f"FAIL   {name:32s} {type(error).__name__}: {str(error)[:1500]}"
        bad += line.startswith("FAIL")
        print(line, flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
