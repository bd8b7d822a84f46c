"""Hot keys: rows joined to an aggregate of their own key are dealt to several tasks."""

from __future__ import annotations

import pytest
from conftest import documents
from pyspark.sql import functions as F

from tenderlake.llm import components as C
from tenderlake.llm import sharding

_LOW = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture
def low_limits(spark):
    before = {k: spark.conf.get(k, None) for k in _LOW}
    for k, v in _LOW.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_node_with_very_many_neighbours(spark, low_limits):
    other = F.xxhash64("id")
    links = spark.range(60_000).select(
        F.when(F.col("id") % 4 < 3, F.lit(-5)).otherwise(other % 1000).cast("long").alias("a"), other.alias("b")
    ).repartition(16)
    assert "skew=true" in _plan(links.join(C._nearest(links), "a"))


def test_group_of_very_many_copies(spark, low_limits, monkeypatch):
    rows = spark.range(60_000).withColumn("text", F.when(F.col("id") % 4 < 3, F.lit("copy")).otherwise(F.sha2(F.col("id").cast("string"), 256)))
    docs = rows.withColumnRenamed("id", "doc_id").repartition(16)
    joined = []
    kept = sharding.indexed
    monkeypatch.setattr(sharding, "indexed", lambda df, *more: joined.append(df) or kept(df, *more))
    found = sharding.shards(docs, shards=4).groupBy("shard").count().collect()
    assert sum(r["count"] for r in found) == 60_000
    assert "skew=true" in _plan(joined[0])


def test_no_rows(spark, low_limits):
    assert sharding.shards(documents(spark, []), shards=4).count() == 0
