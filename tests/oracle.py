"""Runs registered queries against their SQL and compares whole results."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value


def _table(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, sf_dir: str) -> tuple[int, str]:
    """Row count and, unless results agree, what differs."""
    import __spark_entry__ as registered

    df = registered.queries()[name](spark, sf_dir)
    got = _table(df.columns, df.collect())
    sql = registered.oracle_sql().get(name)
    if sql is None:
        return len(got), ""
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    want = _table(columns, cursor.fetchall())
    if sorted(df.columns) != sorted(columns):
        return len(got), f"columns {sorted(df.columns)} and {sorted(columns)}"
    if len(got) != len(want):
        return len(got), f"{len(got)} and {len(want)} rows"
    for a, b in zip(got, want, strict=True):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return len(got), f"{a} and {b}"
    return len(got), ""


if __name__ == "__main__":
    from flockscan.session import local_session

    import __spark_entry__ as registered

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session(8), connect(sf_dir)
    for name in sys.argv[2:] or registered.queries():
        start = time.time()
        try:
            rows, problem = compare(spark, con, name, sf_dir)
        except Exception as error:
            rows, problem = -1, repr(error)[:600]
        print(f"{name:28}{rows:8} {time.time() - start:7.2f}s {problem}", flush=True)
