"""Compares every query that has an oracle with it: ``python tests/oracle_check.py [sf] [key prefix ...]``."""

import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))
import __spark_entry__ as entry  # noqa: E402
from riskweave.session import AT_START  # noqa: E402

TABLES = ["documents", "embeddings", "conversations", "pages", "benchmark", "labels"]


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config(map=AT_START).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def compare(spark, connection, sf_dir, key):
    """(equal, rows, first difference) for one key."""
    frame = entry.queries()[key](spark, sf_dir)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    result = connection.execute(entry.oracle_sql()[key])
    want = rows_of([d[0] for d in result.description], result.fetchall())
    if got == want:
        return True, len(got[1]), ""
    got_set, want_set = set(map(repr, got[1])), set(map(repr, want[1]))
    return False, len(got[1]), (
        f"columns {got[0]} / {want[0]}; rows {len(got[1])} / {len(want[1])}; only here "
        f"{sorted(got_set - want_set)[:3]}; only there {sorted(want_set - got_set)[:3]}")


if __name__ == "__main__":
    sf, prefixes = (sys.argv[1] if len(sys.argv) > 1 else "0.01"), tuple(sys.argv[2:])
    folder = f"/root/testdata/sf{sf}"
    spark_session, duck = session(), oracle(folder)
    failed = 0
    for name in entry.oracle_sql():
        if prefixes and not name.startswith(prefixes):
            continue
        begin = time.time()
        try:
            ok, count, difference = compare(spark_session, duck, folder, name)
        except Exception as error:  # noqa: BLE001
            ok, count, difference = False, 0, str(error)[:600]
        failed += not ok
        print(f"\n{'ok  ' if ok else 'FAIL'} {name} {count} {time.time() - begin:.1f}s {difference[:1500]}", flush=True)
    print("\nfailed:", failed)
