"""What moves between tasks, and how it is compiled, where tables grow."""

from __future__ import annotations

from tenderlake.session import small_methods
from tenderlake.sources import bronze, tables

LIMIT = "spark.sql.codegen.hugeMethodLimit"


def test_methods_that_are_compiled(spark):
    before = spark.conf.get(LIMIT)
    try:
        spark.conf.set(LIMIT, "65535")
        small_methods(spark)
        assert spark.conf.get(LIMIT) == "8000"
        spark.conf.set(LIMIT, "9000")  # a session's own choice stays
        small_methods(spark)
        assert spark.conf.get(LIMIT) == "9000"
    finally:
        spark.conf.set(LIMIT, before)


def test_silver_is_not_moved_again(spark, tmp_path, monkeypatch):
    plans = []
    write = bronze.write_partitioned
    monkeypatch.setattr(bronze, "write_partitioned", lambda *a, **k: plans.append(k) or write(*a, **k))
    monkeypatch.setattr(tables, "silver_columns", lambda rows: rows)
    rows = spark.createDataFrame([("a", 2020, 1), ("b", 2021, 2)], "source string, year bigint, n int")
    tables.write_silver(rows, f"{tmp_path}/silver")
    assert plans == [{"rebalanced": False}]
