"""Labelled documents to learn from: a bounded sample, never from the held-out third."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the third of ids kept from learning; false for null ids, which carry no label."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(text, label) of at most ``rows`` labelled documents outside the held-out third, by hash order.

    Equal texts count once. A document labelled more than once has the larger label; null labels
    are passed over. ``rows`` bounds what is broadcast: one id and label each.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(label).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    return (
        docs.select("doc_id", F.col("text").cast("string").alias("text"))
        .where(F.length("text") > 0)
        .join(F.broadcast(chosen), "doc_id")
        .withColumn("text_key", F.xxhash64("text"))
        .dropDuplicates(["text_key"])
        .select("text", F.col("label").cast("int").alias("label"))
    )
