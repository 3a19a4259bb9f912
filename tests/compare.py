"""Side-by-side run of registered queries and their SQL twins.

``python -m tests.compare [sf] [name part]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import threading
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def spark_session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("veripaper")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        rounded = round(value, 6)
        return 0.0 if rounded == 0 else rounded
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def normalized(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def run_spark(df):
    return df.columns, [tuple(row) for row in df.collect()]


def run_oracle(con, sql: str):
    cursor = con.execute(sql)
    return [c[0] for c in cursor.description], cursor.fetchall()


def compare(df, con, sql: str) -> str | None:
    """None when both give the same rows, else what differs."""
    s_cols, s_rows = run_spark(df)
    o_cols, o_rows = run_oracle(con, sql)
    if sorted(s_cols) != sorted(o_cols):
        return f"columns {sorted(s_cols)} / {sorted(o_cols)}"
    left, right = normalized(s_cols, s_rows), normalized(o_cols, o_rows)
    if left == right:
        return None
    only_l = [r for r in left if r not in set(right)][:3] if len(left) < 50000 else []
    only_r = [r for r in right if r not in set(left)][:3] if len(left) < 50000 else []
    return f"rows {len(left)} / {len(right)}\n   spark {only_l}\n   sql   {only_r}"


def main() -> None:
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    part = sys.argv[2:] or [""]
    folder = f"/root/testdata/sf{sf}"
    spark, con = spark_session(), database(folder)
    oracles = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if not any(p in name for p in part):
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            if name in oracles:
                watchdog = threading.Timer(90, con.interrupt)
                watchdog.start()
                try:
                    problem = compare(df, con, oracles[name])
                finally:
                    watchdog.cancel()
                rows = ""
            else:
                problem, rows = None, f"rows only {len(df.collect())}"
        except Exception as error:  # noqa: BLE001
            problem, rows = f"{type(error).__name__}: {str(error)[:1500]}", ""
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {rows} {problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
