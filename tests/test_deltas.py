"""Latest state by additions: late, repeated and broken batches."""

from __future__ import annotations

import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tenderlake.sources import versions
from tenderlake.streaming import deltas
from tenderlake.streaming.deltas import add_latest, compact_latest, read_latest, stream_additions

SCHEMA = "k string, v int, at string"
KEYS = ["k"]


def order():
    return [F.col("at").desc_nulls_last(), F.col("v").desc()]


def batches(seed):
    g = random.Random(seed)
    rows = [(g.choice("abcdefg"), v, g.choice([None, f"2020-01-{g.randrange(1, 29):02d}"])) for v in range(120)]
    return [rows[k::4] for k in range(4)]


def latest(rows):
    best = {}
    for k, v, at in rows:
        best[k] = max(best.get(k, ("", -1)), (at or "", v))
    return {k: v for k, (_, v) in best.items()}


def state(spark, table):
    rows = read_latest(spark, table, spark.createDataFrame([], SCHEMA).schema, KEYS, order()).collect()
    assert len(rows) == len({r.k for r in rows})
    return {r.k: r.v for r in rows}


def compact(spark, table):
    compact_latest(spark, table, spark.createDataFrame([], SCHEMA).schema, KEYS, order())


def test_any_order_and_repeats(spark, tmp_path):
    parts, table = batches(1), f"{tmp_path}/t"
    assert state(spark, table) == {}
    for n in (2, 0, 2, 3):
        add_latest(spark.createDataFrame(parts[n], SCHEMA), table, KEYS, order(), f"b-{n}")
    assert state(spark, table) == latest(parts[2] + parts[0] + parts[3])
    compact(spark, table)
    add_latest(spark.createDataFrame(parts[0], SCHEMA), table, KEYS, order(), "b-0")  # long since in the base
    add_latest(spark.createDataFrame(parts[1], SCHEMA), table, KEYS, order(), "b-1")
    assert state(spark, table) == latest(sum(parts, []))
    for _ in range(2):
        compact(spark, table)
    assert deltas._added(spark, table) == [] and state(spark, table) == latest(sum(parts, []))
    with pytest.raises(ValueError, match="no name"):
        add_latest(spark.createDataFrame([], SCHEMA), table, KEYS, order(), "../x")


def test_broken_batch_and_compaction(spark, tmp_path, monkeypatch):
    parts, table = batches(2), f"{tmp_path}/t"
    add_latest(spark.createDataFrame(parts[0], SCHEMA), table, KEYS, order(), "b-0")
    # A batch that breaks before its marker does not count, and is written again.
    with monkeypatch.context() as m:
        m.setattr(versions, "create_file", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            add_latest(spark.createDataFrame(parts[1], SCHEMA), table, KEYS, order(), "b-1")
    assert state(spark, table) == latest(parts[0])
    add_latest(spark.createDataFrame(parts[1], SCHEMA), table, KEYS, order(), "b-1")
    # A compaction that breaks before or after its version becomes current.
    for step in ("publish", "remove_folder"):
        compact(spark, table)
        with monkeypatch.context() as m:
            m.setattr(versions, step, lambda *_: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                compact(spark, table)
        assert state(spark, table) == latest(parts[0] + parts[1])
        add_latest(spark.createDataFrame(parts[2], SCHEMA), table, KEYS, order(), "b-2")
        assert state(spark, table) == latest(parts[0] + parts[1] + parts[2])
        parts[0] += parts[2]
    compact(spark, table)
    assert state(spark, table) == latest(parts[0] + parts[1])


def test_stream_that_breaks(spark, tmp_path, monkeypatch):
    parts, table = batches(3), f"{tmp_path}/t"
    schema = spark.createDataFrame([], SCHEMA).schema

    def run(rows):
        if rows:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        arrivals = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        stream_additions(arrivals, table, f"{tmp_path}/c", KEYS, order(), compact_after=2).awaitTermination()

    run(parts[0])
    with monkeypatch.context() as m:
        m.setattr(deltas, "compact_latest", lambda *_: 1 / 0)
        with pytest.raises(StreamingQueryException):
            run(parts[1])
    run([])
    assert state(spark, table) == latest(parts[0] + parts[1])
    run(parts[2] + parts[0])
    run(parts[3])
    assert state(spark, table) == latest(sum(parts, []))
