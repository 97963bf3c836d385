"""Run registered queries against their oracle SQL and report differences.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def normal(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(spark_df, connection, sql: str) -> str | None:
    """None when both sides have the same columns and rows."""
    found = connection.execute(sql)
    columns = [c[0] for c in found.description]
    want = normal(columns, found.fetchall())
    if sorted(columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(columns)}"
    got = normal(spark_df.columns, [tuple(row) for row in spark_df.collect()])
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    wrong = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as registered

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    oracles = registered.oracle_sql()
    bad = 0
    for name, query in registered.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in oracles:
                problem = difference(df, connection, oracles[name])
                state = "ok" if problem is None else "DIFFERS " + problem[:600]
            else:
                state = f"{df.count()} rows, no oracle"
        except Exception as failure:
            state = "FAILED " + str(failure)[:600]
        bad += state.startswith(("DIFFERS", "FAILED"))
        print(f"{name:24} {time.time() - start:6.1f}s  {state}", flush=True)
    print("problems:", bad)


if __name__ == "__main__":
    main()
