"""Latest state per key from a base table and small additions, with no file ever replaced in place.

Each batch adds its newest row of each key as a folder of its own, which counts once its marker file
is there; a batch that is played again writes the same folder again. Readers take the newest row of
each key over the base and all marked additions. Taking the newest is the same in any order and any
number of times, so late batches, repeated ones and additions that the base already has change
nothing. Compaction writes base and additions as a new version of the base, and removes the
additions that went into the version before, which no reader needs any more. A break at any point
leaves at worst files that nobody reads.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tenderlake.operators.canonical import latest_per_key
from tenderlake.sources import versions

_MARK = "_added-"
COMPACT_AFTER = 16  # additions from which a stream compacts


def _added(spark: SparkSession, table: str) -> list[str]:
    """Names of the additions that count."""
    return sorted(n.removeprefix(_MARK) for n in versions.names(spark, f"{table}/added") if n.startswith(_MARK))


def add_latest(batch: DataFrame, table: str, keys: Sequence[str], order: Sequence[Column], name: str) -> None:
    """Add the newest row of each key of a batch. ``name`` tells batches apart; the same name is the same batch."""
    if not re.fullmatch(r"[\w-]+", name):
        raise ValueError(f"{name!r} is no name for a batch")
    latest_per_key(batch, keys, order).write.mode("overwrite").option("compression", "zstd").parquet(f"{table}/added/{name}")
    versions.create_file(batch.sparkSession, f"{table}/added/{_MARK}{name}")


def read_latest(
    spark: SparkSession, table: str, schema: StructType, keys: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    """One row per key of everything that was added so far."""
    folders = [versions.current(spark, table), *[f"{table}/added/{n}" for n in _added(spark, table)]]
    folders = [f for f in folders if f]
    if not folders:
        return spark.createDataFrame([], schema)
    return latest_per_key(spark.read.schema(schema).parquet(*folders), keys, order)


def compact_latest(spark: SparkSession, table: str, schema: StructType, keys: Sequence[str], order: Sequence[Column]) -> None:
    """Make base and additions the new base."""
    merged, before = _added(spark, table), versions.current(spark, table)
    version = versions.new_version(table)
    rows = read_latest(spark, table, schema, keys, order)
    rows.hint("rebalance").write.option("compression", "zstd").parquet(version)
    for name in merged:  # what is in it, as empty files beside the data
        versions.create_file(spark, f"{version}/{_MARK}{name}")
    versions.publish(spark, table, version)
    for name in versions.names(spark, before) if before else []:
        if name.startswith(_MARK):
            versions.remove_folder(spark, f"{table}/added/{name}")
            versions.remove_folder(spark, f"{table}/added/{name.removeprefix(_MARK)}")


def stream_additions(
    rows: DataFrame,
    table: str,
    checkpoint: str,
    keys: Sequence[str],
    order: Sequence[Column],
    *,
    compact_after: int = COMPACT_AFTER,
) -> StreamingQuery:
    """Add what has arrived since the last run, batch by batch, then stop; read it with ``read_latest``."""
    schema, job = rows.schema, re.sub(r"\W", "-", checkpoint.rstrip("/").rsplit("/", 1)[-1])

    def add(batch: DataFrame, number: int) -> None:
        add_latest(batch, table, keys, order, f"{job}-{number:09d}")
        if len(_added(batch.sparkSession, table)) >= compact_after:
            compact_latest(batch.sparkSession, table, schema, keys, order)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
