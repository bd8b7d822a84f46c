"""Exact medians of very large groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Histogram width on the scale of sign(v) * ln(1 + |v|), which keeps the order of values and puts all
# doubles between -710 and 710: a group fills at most 1420 / width bins, whatever its values.
BIN_WIDTH = 1 / 1024


def exact_median(
    df: DataFrame, keys: Sequence[str], value: str, width: float = BIN_WIDTH, weight: str | None = None
) -> DataFrame:
    """(keys, n, median) with the exact median of the non-NULL values per group.

    ``weight`` says how often a row counts, for values that were counted before.

    Spark's own ``median`` gathers all distinct values of a group in one task. Here a histogram
    (pre-aggregated before the shuffle) locates the bin that holds the middle rank, and only that
    bin's distinct values are ranked, so no group is ever brought together.
    """
    keys = list(keys)
    scaled = F.signum(value) * F.log1p(F.abs(F.col(value)))
    binned = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).alias("_v"), F.floor(scaled / width).alias("_bin"),
        (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("_w"),
    )
    histogram = binned.groupBy(*keys, "_bin").agg(F.sum("_w").alias("_c"))
    group = Window.partitionBy(*keys)
    running = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = histogram.select(
        "*", F.sum("_c").over(running).alias("_to"), F.sum("_c").over(group).alias("n")
    ).withColumns({
        "_before": F.col("_to") - F.col("_c"),
        "_low": F.floor((F.col("n") + 1) / 2),
        "_high": F.floor(F.col("n") / 2) + 1,
    })
    middle = ranked.where("(_before < _low AND _low <= _to) OR (_before < _high AND _high <= _to)")
    inside = (
        binned.join(middle.select(*keys, "_bin", "n", "_before", "_low", "_high"), [*keys, "_bin"])
        .groupBy(*keys, "_bin", "n", "_before", "_low", "_high", "_v")
        .agg(F.sum("_w").alias("_c"))
    )
    in_bin = (
        Window.partitionBy(*keys, "_bin")
        .orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    upto = inside.withColumn("_to", F.col("_before") + F.sum("_c").over(in_bin))
    hit = upto.withColumn("_from", F.col("_to") - F.col("_c")).where(
        "(_from < _low AND _low <= _to) OR (_from < _high AND _high <= _to)"
    )
    return hit.groupBy(*keys).agg(
        F.max("n").alias("n"), ((F.min("_v") + F.max("_v")) / 2).alias("median")
    )
