"""Joins on ranges without cross joins: keys are cut into cells, cells are joined by equality.

Spark has no range join of its own; a band of width w only reaches rows of the same or a
neighbouring cell of width w, so each row meets a bounded neighbourhood whatever the table's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band_pairs(rows: DataFrame, keys: list[str], value: str, width: float, payload: list[str]) -> DataFrame:
    """Pairs (lo, hi) of one group with 0 < hi.value - lo.value <= width; payload columns get _lo and _hi.

    Equal values pair up once, by the order of the payload after the value.
    """
    cell = F.floor(F.col(value) / width)
    rows = rows.withColumn("_id", F.struct(value, *[c for c in payload if c != value]))
    lo = rows.select(*keys, F.explode(F.array(cell, cell + 1)).alias("_cell"), *[F.col(c).alias(f"{c}_lo") for c in payload], F.col("_id").alias("_a"))
    hi = rows.select(*keys, cell.alias("_cell"), *[F.col(c).alias(f"{c}_hi") for c in payload], F.col("_id").alias("_b"))
    joined = lo.join(hi, [*keys, "_cell"])
    return joined.filter((F.col("_a") < F.col("_b")) & (F.col("_b")[value] - F.col("_a")[value] <= width)).drop("_cell", "_a", "_b")


def near_pairs(left: DataFrame, right: DataFrame, keys: list[str], value: str, other: str, width: float) -> DataFrame:
    """Rows of two tables of one group with |value - other| <= width."""
    cell = F.floor(F.col(other) / width)
    spread = right.withColumn("_cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    met = left.withColumn("_cell", F.floor(F.col(value) / width)).join(spread, [*keys, "_cell"])
    return met.filter(F.abs(F.col(value) - F.col(other)) <= width).drop("_cell")


def outside_bands(rows: DataFrame, centres: DataFrame, keys: list[str], value: str, centre: str, half_width: float) -> DataFrame:
    """Rows of which no centre of their group lies within half_width (an anti join on ranges)."""
    cell = F.floor(F.col(centre) / half_width)
    marks = centres.select(*keys, F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"), F.col(centre).alias("_centre"))
    left = rows.withColumn("_cell", F.floor(F.col(value) / half_width))
    on = [left[k] == marks[k] for k in [*keys, "_cell"]] + [F.abs(left[value] - marks["_centre"]) <= half_width]
    return left.join(marks, on, "left_anti").drop("_cell")


def nearest(rows: DataFrame, points: DataFrame, keys: list[str], value: str, point: str, half_width: float, ties: list[Column]) -> DataFrame:
    """Each row with its group's nearest point within half_width; ties by the given order, then the smaller point."""
    cell = F.floor(F.col(point) / half_width)
    spread = points.withColumn("_cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    left = rows.withColumn("_cell", F.floor(F.col(value) / half_width))
    met = left.join(spread, [*keys, "_cell"]).filter(F.abs(F.col(value) - F.col(point)) <= half_width)
    order = Window.partitionBy(*[c for c in rows.columns]).orderBy(F.abs(F.col(value) - F.col(point)), *ties, point)
    return met.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank", "_cell")


def lookup_interval(rows: DataFrame, value: Column, table: list[tuple[float, float, object]], names: tuple[str, str]) -> DataFrame:
    """A short table of (low, high, label) joined where low < value <= high; null outside.

    The table is a literal of the query, so its size is fixed and it is broadcast.
    """
    spark = rows.sparkSession
    kind = "string" if isinstance(table[0][2], str) else "double"
    marks = spark.createDataFrame(table, f"_lo double, _hi double, {names[0]} {kind}")
    return rows.join(F.broadcast(marks), (value > F.col("_lo")) & (value <= F.col("_hi")), "left").withColumn(names[1], F.col("_hi")).drop("_lo", "_hi")


def covered_length(intervals: DataFrame, keys: list[str], low: str, high: str) -> DataFrame:
    """Total length of the union of each group's intervals, and the number of its separate parts."""
    order = Window.partitionBy(*keys).orderBy(low, high)
    before = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("_new", (before.isNull() | (F.col(low) > before)).cast("int"))
    parts = marked.withColumn("_part", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    each = parts.groupBy(*keys, "_part").agg(F.min(low).alias("_lo"), F.max(high).alias("_hi"))
    return each.groupBy(*keys).agg(F.sum(F.col("_hi") - F.col("_lo")).alias("covered"), F.count("*").alias("parts"))
