"""Sums of doubles that are the same, to the last bit, in whatever order rows and partial sums meet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Doubles below ``LIMIT`` are cut into a multiple of ``STEP`` and a rest of whole ``FINEST``; both add up exactly.
LIMIT, STEP, FINEST = 2.0**33, 2.0**-20, 2.0**-53


def rounded_sum(value: Column, digits: int = 9) -> Column:
    """Aggregate: the sum to ``digits`` decimals, at most 12.

    It doesn't depend on the order while a group's absolute values add up to less than 2^33 and its
    rows are fewer than 2^21; beyond that it is right as any sum of doubles is.
    """
    small = F.abs(value) < LIMIT
    whole = F.when(small, F.rint(value / STEP) * STEP).otherwise(value)
    rest = F.when(small, F.rint((value - whole) / FINEST) * FINEST).when(value.isNotNull(), 0.0)
    return F.round(F.sum(whole) + F.sum(rest), digits)
