"""Grouped totals that also report a name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.functions.money import fixed_part, huge_part, joined


def named_totals(
    rows: DataFrame,
    keys: Sequence[str],
    names: Mapping[str, str],
    counts: Mapping[str, Column],
    amounts: Mapping[str, Column],
) -> DataFrame:
    """Counts and exact sums per key with the first spelling (in text order) of each name.

    ``names`` maps result columns to name columns. A minimum over text cannot be kept in Spark's
    hash aggregation and would sort all rows. The spellings therefore join the grouping key in a
    first, purely numeric hash aggregation; the minimum is taken over its few result rows.
    """
    spellings = rows.groupBy(*keys, *names.values()).agg(
        *[F.count_if(cond).alias(name) for name, cond in counts.items()],
        *[F.sum(fixed_part(a)).alias(f"{name}_fixed") for name, a in amounts.items()],
        *[F.sum(huge_part(a)).alias(f"{name}_huge") for name, a in amounts.items()],
    )
    return spellings.groupBy(*keys).agg(
        *[F.min(column).alias(name) for name, column in names.items()],
        *[F.sum(name).alias(name) for name in counts],
        *[joined(F.sum(f"{a}_fixed"), F.sum(f"{a}_huge")).alias(a) for a in amounts],
    )
