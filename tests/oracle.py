"""Runs queries and their SQL side by side and compares rows as multisets."""

import math
import os
import sys
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (Decimal, float)):
        return round(float(v), 6) + 0.0
    if isinstance(v, bool):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return int(v) if isinstance(v, int) else str(v)


def rows_of_sql(text, sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = con.sql(text)
    return found.columns, found.fetchall()


def compare(spark, name, query, text, sf_dir):
    df = query(spark, sf_dir)
    columns, want = rows_of_sql(text, sf_dir)
    assert sorted(columns) == sorted(df.columns), (name, sorted(columns), sorted(df.columns))
    order = sorted(columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in want), key=repr)
    odd = [(a, b) for a, b in zip(got, want) if a != b]
    assert len(got) == len(want) and not odd, (name, order, len(got), len(want), odd[:3], got[:2], want[:2])
    return len(got)


if __name__ == "__main__":
    import time

    sys.path.insert(0, os.getcwd())
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    for n in sys.argv[2:] or queries:
        began = time.time()
        try:
            n_rows = compare(session, n, queries[n], oracles[n], sys.argv[1]) if n in oracles else queries[n](session, sys.argv[1]).count()
            print("ok  " if n in oracles else "rows", n, n_rows, round(time.time() - began, 1), flush=True)
        except Exception as e:
            print("BAD ", n, str(e)[:1200], flush=True)
