"""Compare registered queries with their SQL counterparts on DuckDB."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
#: The tables that tests run on.
SF = "/root/testdata/sf0.001"


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return repr(v)


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark: SparkSession, con, query, folder: str, sql: str | None) -> str:
    """An empty text when both sides agree, else what differs; without SQL there must be rows."""
    df = query(spark, folder)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return "" if got else "no rows"
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = canonical(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    if got != want:
        a, b = set(got), set(want)
        return (f"rows {len(got)} against {len(want)}; only in Spark {sorted(a - b)[:3]}; "
                f"only in SQL {sorted(b - a)[:3]}; columns {sorted(names)}")
    if not got:
        return "both sides are empty"
    return ""


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = sys.argv[1:] or list(entry.queries())
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for n in names:
        t = time.time()
        try:
            problem = compare(spark, con, entry.queries()[n], folder, entry.oracle_sql().get(n))
        except Exception as e:
            problem = "".join(traceback.format_exception_only(e))[:1500]
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {n} {time.time() - t:.2f}s {problem}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main()
