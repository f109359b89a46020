"""Run queries in Spark and their SQL in DuckDB, and compare whole results."""

from __future__ import annotations

import datetime
import decimal
import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402


def database(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    if isinstance(value, decimal.Decimal):
        return int(value) if value == int(value) else float(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(
        (tuple(normal(r[i]) for i in order) for r in rows), key=lambda r: [str(v) for v in r])


def compare(spark, con, name: str, sf_dir: str) -> str:
    df = entry.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows only: {len(got[1])}"
    cursor = con.execute(sql)
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"DIFFERENT columns {got[0]} / {want[0]}"
    if got[1] != want[1]:
        a, b = set(map(str, got[1])), set(map(str, want[1]))
        return f"DIFFERENT rows {len(got[1])} / {len(want[1])}\n  spark {sorted(a - b)[:3]}\n  sql   {sorted(b - a)[:3]}"
    return f"ok {len(got[1])}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = database(sf_dir)
    for name in names or entry.queries():
        began = time.time()
        try:
            result = compare(spark, con, name, sf_dir)
        except Exception as error:  # noqa: BLE001
            result = f"FAILED {str(error)[:600]}"
        print(f"{name:22s} {time.time() - began:6.1f}s {result}", flush=True)
