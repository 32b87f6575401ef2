"""Run registered queries against DuckDB on one data folder and compare the rows.

    python tests/compare.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def make_spark(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def duck(sf_dir: str):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, bytearray):
        return bytes(v)
    if isinstance(v, list):
        return tuple(norm(x) for x in v)
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(norm(v) for v in r) for r in df.select(*cols).collect())


def duck_rows(con, sql):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(norm(r[i]) for i in order) for r in rel.fetchall())


def check(spark, con, sf_dir, name, fn, sql):
    """(ok, text)"""
    t = time.time()
    cols, rows = spark_rows(fn(spark, sf_dir))
    took = time.time() - t
    if sql is None:
        return True, f"{sum(rows.values())} rows, no SQL, {took:.1f}s"
    t = time.time()
    dcols, drows = duck_rows(con, sql)
    dtook = time.time() - t
    if cols != dcols:
        return False, f"columns {cols} != {dcols}"
    if rows != drows:
        a, b = list((rows - drows).items())[:3], list((drows - rows).items())[:3]
        return False, f"rows {sum(rows.values())} != {sum(drows.values())}; only spark {a}; only sql {b}"
    return True, f"{sum(rows.values())} rows, spark {took:.1f}s, sql {dtook:.1f}s"


def main(argv):
    import __spark_entry__ as E

    sf_dir = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        sf_dir, argv = argv[1], argv[2:]
    spark, con = make_spark(), duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if argv and not any(name.startswith(a) for a in argv):
            continue
        try:
            ok, text = check(spark, con, sf_dir, name, fn, sqls.get(name))
        except Exception as e:  # report and go on with the next query
            ok, text = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, text, flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
