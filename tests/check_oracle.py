"""Compare registered queries with their SQL: python tests/check_oracle.py [sf dir] [name ...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as E  # noqa: E402
from tenderlake.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns and rows in a fixed order, values as comparable text."""
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        kind = frame[c].dtype
        if pd.api.types.is_float_dtype(kind) or pd.api.types.is_integer_dtype(kind):
            frame[c] = frame[c].map(lambda v: "" if pd.isna(v) else f"{float(v):.10g}")
        else:
            frame[c] = frame[c].map(lambda v: "" if pd.isna(v) else str(v))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def difference(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {set(spark_frame.columns) ^ set(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"rows {len(spark_frame)} != {len(sql_frame)}"
    a, b = normal(spark_frame), normal(sql_frame)
    for c in a.columns:
        bad = a[c] != b[c]
        if bad.any():
            return f"{c}: {bad.sum()} rows, e.g. {a[c][bad].iloc[0]!r} != {b[c][bad].iloc[0]!r}"
    return None


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session("check", 8, **{"spark.driver.memory": "12g", "spark.sql.execution.arrow.pyspark.enabled": "true"}), connect(sf_dir)
    sql = E.oracle_sql()
    failed = 0
    for name, query in E.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        started = time.time()
        try:
            got = query(spark, sf_dir).toPandas()
            spent = time.time() - started
            if name not in sql:
                print(f"rows  {name} {len(got)} {spent:.1f}s")
                continue
            problem = difference(got, con.execute(sql[name]).df())
        except Exception as e:  # noqa: BLE001
            spent, problem, got = time.time() - started, f"{type(e).__name__}: {str(e)[:600]}", []
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '}  {name} rows={len(got)} {spent:.1f}s {problem or ''}", flush=True)
    print(f"{failed} failed; registered {len(E.queries())}, with SQL {len(sql)}")
    return failed


if __name__ == "__main__":
    sys.exit(main())
