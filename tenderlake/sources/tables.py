"""Silver, search-index and Gold tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlake.functions.contract import comparable_amount, status_rank
from tenderlake.schema import SILVER_SCHEMA
from tenderlake.sources import versions
from tenderlake.sources.bronze import replace_table

_INDEX_ROW_GROUP = 100_000


def silver_columns(contracts: DataFrame) -> DataFrame:
    return contracts.withColumn("importe", F.round("importe", 2)).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in SILVER_SCHEMA.fields]
    )


def write_silver(contracts: DataFrame, path: str) -> None:
    """Replace Silver as a whole: nothing of the table before stays, whatever partitions it had.

    The rows come from the shuffle of the deduplication, spread by record key, and are not moved again.
    """
    replace_table(silver_columns(contracts), path, ("source", "year"), rebalanced=False)


def read_silver(spark: SparkSession, path: str) -> DataFrame:
    found = versions.read_or_empty(spark, versions.current(spark, path), SILVER_SCHEMA)
    return found.select(SILVER_SCHEMA.names)


def contracts_of(silver: DataFrame) -> DataFrame:
    """Silver as the marts need it: unrounded amount and status rank are derived again."""
    return silver.withColumns({
        "importe": comparable_amount(),
        "status_rank": status_rank(F.col("estado")),
    })


def write_index(index: DataFrame, path: str) -> int:
    """Search index with row groups small enough for range reads; returns its row count."""
    (
        index.write.mode("overwrite")
        .option("compression", "zstd")
        .option("parquet.block.row.count.limit", str(_INDEX_ROW_GROUP))
        .parquet(path)
    )
    return index.sparkSession.read.parquet(path).count()


def json_lines(mart: DataFrame) -> DataFrame:
    names = [F.col(c) for c in mart.columns]
    return mart.select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value"))


def write_gold(mart: DataFrame, folder: str, name: str) -> int:
    """Parquet plus a copy as JSON lines of one mart; returns its row count.

    The mart is computed once, and the JSON is made from the stored Parquet.
    """
    table = f"{folder}/{name}.parquet"
    mart.write.mode("overwrite").option("compression", "zstd").parquet(table)
    stored = mart.sparkSession.read.parquet(table)
    json_lines(stored).write.mode("overwrite").text(f"{folder}/{name}.json")
    return stored.count()


def read_gold(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
