"""Expressions of the ledger and coverage: cheap forms give what the plain ones gave."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tenderlake.operators import coverage as C
from tenderlake.plans import ledger as L


def plan_of(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


def test_cents_are_rounded_as_before(spark):
    given = [0.0, -0.0, 0.005, -0.005, 0.285, 1.005, 2.675, 0.0049999999999999994, 104999.91, -7.125, 1e-300, 45035996273704.955, 9e16, -9e16, None]
    given += [k / 1000 for k in range(-3000, 3000, 7)]
    df = spark.createDataFrame([(x,) for x in given], "x double")
    got = df.select(L.cents(F.col("x")), F.round(F.col("x") * 100).cast("bigint")).collect()
    assert [(a, b) for a, b in got if a != b] == []
    assert "FLOOR" in plan_of(df.select(L.cents(F.col("x")).alias("y")))


def test_dates_are_shifted_as_before(spark):
    given = [datetime(2000, 2, 29), datetime(1992, 1, 1), datetime(1998, 12, 31, 23, 59, 59), datetime(9990, 10, 9), datetime(5, 3, 4), None]
    df = spark.createDataFrame([(x,) for x in given], "ts timestamp")
    before = F.concat((F.year("ts") + L.YEAR_SHIFT).cast("string"), F.date_format("ts", "-MM-dd"))
    assert [a for a, b in df.select(L.shifted_date(F.col("ts")), before).collect() if a != b] == []
    assert "date_format" not in plan_of(df.select(L.shifted_date(F.col("ts"))))


def test_only_texts_are_searched_for_blanks(spark):
    rows = [("a", 2020, " ", 1.0, True, b" "), ("a", 2020, None, None, None, None), ("a", 2020, " x", float("nan"), False, b"1")]
    df = spark.createDataFrame(rows, "source string, year bigint, t string, d double, b boolean, bin binary")
    fields = ("t", "d", "b", "bin")
    counts = C.coverage_counts(df, fields)
    assert [(r["filled"], r["rows"]) for r in counts.collect()] == [([1, 2, 2, 1], 3)]
    assert plan_of(counts).count("cast(d#") == 0  # numbers were made texts
    assert [r.cobertura_bits for r in C.with_coverage(df, fields).collect()] == [6, 0, 15]
