"""Runs registered queries in Spark and their SQL in DuckDB, and compares the rows.

    python -m checks.compare /root/testdata/sf0.01 [query prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def open_duckdb(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if not os.path.exists(f"{sf_dir}/{t}.parquet"):
            continue
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]

    def nulls_first(row: tuple):
        return tuple((v is not None, str(type(v)), 0 if v is None else v) for v in row)

    return sorted(out, key=nulls_first)


def differences(spark_df, con, sql: str) -> str | None:
    """None when the results are equal, otherwise what differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = _rows(names, cursor.fetchall())
    got = _rows(spark_df.columns, spark_df.collect())
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    if len(got) != len(expected):
        return f"{len(got)} rows, expected {len(expected)}"
    for g, e in zip(got, expected):
        if g != e or any(type(a) is not type(b) for a, b in zip(g, e)):
            bad = [(n, a, b) for n, a, b in zip(sorted(names), g, e) if a != b or type(a) is not type(b)]
            return f"row differs in {bad[:4]}"
    return None


def main(sf_dir: str, prefixes: list[str]) -> int:
    from checks.oracle import ORACLE
    from checks.queries import all_queries
    from holdfast.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = open_duckdb(sf_dir)
    failed = 0
    for name, query in all_queries().items():
        if name not in ORACLE or (prefixes and not name.startswith(tuple(prefixes))):
            continue
        start = time.time()
        try:
            problem = differences(query(spark, sf_dir), con, ORACLE[name])
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        print(f"{name:32s} {time.time() - start:6.2f}s {problem or 'equal'}", flush=True)
    print(f"{failed} differ")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
