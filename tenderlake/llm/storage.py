"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.session import shared_folder


def stored(df: DataFrame, apart: str | None = None, codec: str | None = None) -> DataFrame:
    """Compute ``df`` once into a Parquet table below ``spark.checkpoint.dir`` and read it back.

    This cuts the lineage: a lost executor costs no more than the tasks that ran on it. The table
    goes when the driver's JVM ends. Rows of each value of the column ``apart`` get files of their own. ``codec`` is a
    Parquet compression other than the session's, for tables that are read several times.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(apart) if apart else df.write
    writer.parquet(path, compression=codec)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame, leave_out: str | None = None) -> Column:
    """All columns but one as a struct, so that no name can clash with an operator's own."""
    fields = [F.col(f"`{c}`") for c in docs.columns if c != leave_out]
    return F.struct(*fields or [F.lit(0).alias("none")]).alias("row")


def unpacked(df: DataFrame, columns: list[str], apart: str | None = None) -> DataFrame:
    """The packed columns again, in their order; ``apart`` was not packed."""
    return df.select(*[F.col(c) if c == apart else F.col("row").getField(c).alias(c) for c in columns])
