"""Global positions in an order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.llm.storage import stored

_IN_PART = 33  # monotonically_increasing_id keeps the row number in the lower 33 bits


def indexed(df: DataFrame, order: list[str | Column], weight: str | None = None) -> DataFrame:
    """Add ``row_index``, the 0-based position of each row in ``order``, and with ``weight`` also
    ``row_start``, the sum of that column over all earlier rows.

    Rows are range-partitioned and sorted once; what crosses partitions is a count and a sum for
    each of them. ``order`` should tell rows apart: rows equal in it stay in one partition, and
    their order among themselves is arbitrary but fixed, as the sorted table is stored.
    """
    part = F.shiftright("_place", _IN_PART).alias("_part")
    placed = stored(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    ).withColumn("_part", part)
    total = F.sum(weight) if weight else F.lit(0)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_rows"), total.cast("long").alias("_weight"))
        .select(
            "_part",
            F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
            F.coalesce(F.sum("_weight").over(earlier), F.lit(0)).alias("_weight_before"),
        )
    )
    # One row for each partition of the sorted table, so this side is bounded by the shuffle width.
    out = placed.join(F.broadcast(offsets), "_part").withColumn(
        "row_index", F.col("_rows_before") + F.col("_place").bitwiseAND((1 << _IN_PART) - 1)
    )
    if weight:
        before = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn(
            "row_start", F.col("_weight_before") + F.coalesce(F.sum(weight).over(before), F.lit(0)).cast("long")
        )
    return out.drop("_part", "_place", "_rows_before", "_weight_before")
