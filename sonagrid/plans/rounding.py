"""Doubles to a stated number of decimals on both sides of a comparison; sums differ in their last bits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """All double columns rounded, -0.0 as 0.0, NaN as null."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        out.append((F.round(F.when(~F.isnan(c), c), digits) + F.lit(0.0)).alias(name) if kind == "double" else c)
    return df.select(*out)


def rounded_sql(sql: str, doubles: str, others: str = "note", digits: int = DIGITS) -> str:
    """The rows of ``sql`` with the named columns, doubles rounded as :func:`rounded` does."""
    head = sql[: sql.upper().rindex("\nSELECT")] if sql.lstrip().upper().startswith("WITH") else ""
    body = sql[len(head) :]
    keep = [*others.split(), *[f"round(CAST({d} AS DOUBLE), {digits}) + 0.0 AS {d}" for d in doubles.split()]]
    return f"{head}\nSELECT {', '.join(keep)} FROM ({body}) AS rows_"
