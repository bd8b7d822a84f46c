"""Order-independent money sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EXACT = "decimal(28,6)"
_EXACT_LIMIT = 1e22


def fixed_part(amount: Column) -> Column:
    """Amount in fixed point; NULL where it does not fit."""
    return F.when(F.abs(amount) < _EXACT_LIMIT, amount).cast(_EXACT)


def huge_part(amount: Column) -> Column:
    """Amount where it does not fit the fixed-point type (typing errors), else NULL."""
    return F.when(~(F.abs(amount) < _EXACT_LIMIT), amount)


def joined(fixed: Column, huge: Column) -> Column:
    """Total of the two summed parts as a double; NULL when neither holds an amount."""
    total = fixed.cast("double")
    return F.when(huge.isNull(), total).otherwise(F.coalesce(total, F.lit(0.0)) + huge)


def exact_sum(amount: Column) -> Column:
    """Sum that partitioning, retries and row order cannot change; NULL without amounts."""
    return joined(F.sum(fixed_part(amount)), F.sum(huge_part(amount)))


def money(amount: Column) -> Column:
    """Exact sum rounded to cents."""
    return F.round(exact_sum(amount), 2)


def unflagged(flag: Column, amount: Column) -> Column:
    """Amount with flagged rows counted as zero (an all-flagged group sums to zero)."""
    return F.when(flag, F.lit(0.0)).otherwise(amount)


def share(part: Column, whole: Column, digits: int) -> Column:
    """Rounded percentage; NULL for an empty whole."""
    return F.round(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), digits)
