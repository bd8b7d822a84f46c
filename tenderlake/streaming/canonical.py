"""Latest state per key, kept up to date batch by batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tenderlake.operators.canonical import (
    RECORD_KEY,
    latest_first,
    latest_per_key,
    with_match_keys,
)
from tenderlake.schema import BRONZE_SCHEMA
from tenderlake.sources import versions
from tenderlake.sources.versions import read_or_empty


def _kept_buckets(spark: SparkSession, table: str, buckets: int) -> int:
    """The table's number of buckets, stored beside it by the first batch."""
    beside = f"{table.rstrip('/')}-buckets"
    stored = read_or_empty(spark, beside, "buckets int").first()
    if stored is None:
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(beside)
        return buckets
    return stored.buckets


def merge_latest(
    batch: DataFrame, table: str, keys: Sequence[str], order: Sequence[Column], buckets: int
) -> None:
    """Merge a batch into a table that holds one row per key.

    The table is split by key hash; only the buckets the batch touches are read and replaced.
    Taking the latest row is idempotent, so a replayed batch changes nothing. The table is derived
    data: should the driver die while partitions are swapped, rebuild it from Bronze. The number of
    buckets belongs to the table: another one than it was made with is refused.
    """
    spark = batch.sparkSession
    kept = _kept_buckets(spark, table, buckets)
    if kept != buckets:
        raise ValueError(f"{table} has {kept} buckets, not {buckets}")
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    newest = latest_per_key(batch, keys, order).withColumn("bucket", bucket).persist()
    try:
        touched = [r.bucket for r in newest.select("bucket").distinct().collect()]  # at most `buckets`
        if touched:
            current = read_or_empty(spark, table, newest.schema).where(F.col("bucket").isin(touched))
            merged = latest_per_key(current.select(newest.columns).unionByName(newest), keys, order)
            (
                merged.hint("rebalance", "bucket")
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .option("compression", "zstd")
                .partitionBy("bucket")
                .parquet(table)
            )
    finally:
        newest.unpersist()


def stream_latest(
    rows: DataFrame,
    table: str,
    checkpoint: str,
    keys: Sequence[str],
    order: Sequence[Column],
    *,
    buckets: int = 64,
) -> StreamingQuery:
    """Keep ``table`` at the latest row per key for everything that has arrived, then stop."""
    return (
        rows.writeStream.foreachBatch(lambda batch, _: merge_latest(batch, table, keys, order, buckets))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_contracts(
    spark: SparkSession, bronze: str, table: str, checkpoint: str, *, buckets: int = 256
) -> StreamingQuery:
    """Keep the canonical record of every procurement file up to date with Bronze.

    The table holds Bronze columns; derive the others from it as from Bronze. The run reads the version
    of Bronze that is current when it starts; the files of a new version are seen again and change nothing.
    """
    arrivals = spark.readStream.schema(BRONZE_SCHEMA).parquet(versions.current(spark, bronze))
    return stream_latest(
        with_match_keys(arrivals), table, checkpoint, RECORD_KEY, latest_first(), buckets=buckets
    )
