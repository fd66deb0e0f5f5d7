"""Runs each catalogued query beside its SQL and compares rows. Usage: python tests/compare.py SF_DIR [NAME...]"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9)
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=lambda r: tuple((x is None, str(type(x)), x) for x in map(str, r)))


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


def compare(spark, con, sf, name, query, sql):
    df = query(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    assert sorted(df.columns) == sorted(names), (name, df.columns, names)
    if got != want:
        diff = [(a, b) for a, b in zip(got, want, strict=False) if a != b][:3]
        raise AssertionError(f"{name}: {len(got)} rows and {len(want)}; first differences {diff}")
    return len(got)


if __name__ == "__main__":
    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf, only = sys.argv[1], sys.argv[2:]
    con, queries = connect(sf), e.queries()
    for name, sql in e.oracle_sql().items():
        if not only or name in only:
            t = time.time()
            try:
                n = compare(spark, con, sf, name, queries[name], sql)
                print(f"ok   {name}: {n} rows, {time.time() - t:.1f} s", flush=True)
            except Exception as x:
                print(f"FAIL {name}: {str(x)[:600]}", flush=True)
