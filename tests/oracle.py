"""Run registered queries in Spark and their SQL in DuckDB and compare the results.

    python tests/oracle.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
        if isinstance(v, float) and v != v:
            return None
    return v


def rows_of(frame: pd.DataFrame):
    cols = sorted(frame.columns)
    out = [tuple(_plain(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False, name=None)]
    return cols, sorted(out, key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    """None when equal, else a short account of the difference."""
    df = query(spark, sf_dir)
    got_cols, got = sorted(df.columns), sorted(
        (tuple(_plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr
    )
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want_cols = [names[i] for i in order]
    want = sorted((tuple(_plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    duck = {d[0]: str(d[1]) for d in cur.description}
    bad = [
        (c, types[c], duck[c])
        for c in got_cols
        if {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}.get(types[c]) != duck[c]
    ]
    note = f" types {bad}" if bad else ""
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}{note}"
    diff = [(g, w) for g, w in zip(got, want) if g != w]
    if diff:
        return f"{len(diff)} of {len(got)} rows differ, e.g. {got_cols} {diff[0]}{note}"
    if not got:
        return "both empty"
    return note.strip() or None


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in args.names or queries:
        t = time.time()
        try:
            res = compare(spark, con, name, queries[name], sqls.get(name), args.sf)
        except Exception as e:  # report and go on with the next query
            res = f"ERROR {str(e)[:600]}"
        failed += res is not None
        print(f"{'ok  ' if res is None else 'FAIL'} {name} {time.time() - t:.1f}s {'(no sql) ' if name not in sqls else ''}{res or ''}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
