"""Run registered queries against their check SQL: python -m checks.compare SF_DIR [name ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from . import registry


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("parcelgrid-check")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, (int, float)):
        return "nan" if math.isnan(value) else float(value) + 0.0
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark: SparkSession, con, sf_dir: str, name: str) -> tuple[bool, str]:
    start = time.time()
    df = registry.QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    took = time.time() - start
    if name not in registry.ORACLES:
        return True, f"{len(got)} rows, no SQL, {took:.1f}s"
    start = time.time()
    cursor = con.execute(registry.ORACLES[name])
    names = [c[0] for c in cursor.description]
    want = rows_of(names, cursor.fetchall())
    note = f"{len(got)} rows, spark {took:.1f}s duckdb {time.time() - start:.1f}s"
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    if got != want:
        a, b = set(got), set(want)
        return False, f"{note}; want {len(want)}; only spark {list(a - b)[:2]}; only sql {list(b - a)[:2]}"
    return True, note


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(registry.QUERIES)
    spark, con = session(), duck(sf_dir)
    bad = 0
    for name in names:
        try:
            ok, note = compare(spark, con, sf_dir, name)
        except Exception as error:  # report and go on
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")
    return bad


if __name__ == "__main__":
    sys.exit(main())
