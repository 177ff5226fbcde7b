"""Run a registered query and its SQL counterpart and compare the values.

    python tests/oracle.py 0.01 [name prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import tempfile
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def duck_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, decimal.Decimal):
        return "dec:" + str(value.normalize())
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return f"{type(value).__name__}:{value}"


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    import __spark_entry__ as entry
    df = entry.queries()[name](spark, sf_dir)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None if got[1] else "no rows"
    cur = con.execute(sql)
    want = table([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] == want[1]:
        return None if got[1] else "both empty"
    extra, lacking = sorted(set(got[1]) - set(want[1])), sorted(set(want[1]) - set(got[1]))
    return (f"rows {len(got[1])} vs {len(want[1])}; differing {len(extra)}/{len(lacking)}\n  {got[0]}\n"
            f"  spark {extra[:3]}\n  duck  {lacking[:3]}")


def session():
    from tidemark.session import build_session
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                   "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
                                                   "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-oracle-", dir="/tmp")})
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry
    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    spark, con = session(), duck_connection(sf_dir)
    names = [n for n in entry.queries() if not sys.argv[2:] or n.startswith(tuple(sys.argv[2:]))]
    bad = 0
    for name in names:
        started = time.time()
        try:
            result = compare(spark, con, name, sf_dir)
        except Exception as exc:  # noqa: BLE001
            result = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += result is not None
        print(f"{'ok ' if result is None else 'BAD'} {name} {time.time() - started:.1f}s {result or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")
