"""Run registered queries on Spark and their SQL in DuckDB, and compare rows.

    python tests/compare.py [--sf DIR] [key ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def session(cores: str = "8") -> SparkSession:
    return (SparkSession.builder.master(f"local[{cores}]").appName("compare")
            .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
            .config("spark.ui.showConsoleProgress", "false").getOrCreate())


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else (int(value) if value == int(value) and abs(value) < 1e15 else value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, folder) -> tuple[bool, str]:
    start = time.time()
    frame = fn(spark, folder)
    got = frame.collect()
    spent = time.time() - start
    note = f"{len(got)} rows {spent:.1f}s"
    if sql is None:
        return True, f"rows only, {note}"
    start = time.time()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    note += f" sql {time.time() - start:.1f}s"
    if sorted(names) != sorted(frame.columns):
        return False, f"columns {sorted(frame.columns)} vs {sorted(names)}"
    left, right = rows_of(frame.columns, got), rows_of(names, want)
    if left == right:
        return (True, note) if left else (False, f"EMPTY {note}")
    only_left = [x for x in left if x not in set(right)][:3] if len(left) < 200000 else []
    only_right = [x for x in right if x not in set(left)][:3] if len(right) < 200000 else []
    return False, f"{len(left)} vs {len(right)} rows\n   cols  {sorted(names)}\n   spark {only_left}\n   sql   {only_right}"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("keys", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(args.sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = []
    for name in args.keys or sorted(queries):
        try:
            ok, note = compare(spark, con, name, queries[name], oracle.get(name), args.sf)
        except Exception as error:  # report and go on with the next key
            ok, note = False, f"{type(error).__name__}: {str(error)[:900]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(bad)} failing: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
