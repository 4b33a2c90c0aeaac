"""Columns that an operator only carries along, under names that can't meet its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def carried(docs: DataFrame, *apart: str) -> Column:
    """All columns of ``docs`` but ``apart`` as one struct."""
    others = [c for c in docs.columns if c not in apart]
    return F.struct(*[F.col(f"`{c}`").alias(c) for c in others]) if others else F.struct(F.lit(True).alias("none"))


def restored(columns: list[str], struct: str, *apart: str) -> list[Column]:
    """The columns that :func:`carried` put into ``struct``, and those ``apart``, in their old order."""
    return [F.col(c) if c in apart else F.col(struct)[c].alias(c) for c in columns]
