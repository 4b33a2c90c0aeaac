"""Normalisation, outliers and ranks over a metric column.

Corpus-wide statistics are one partial aggregation to a single row, which is broadcast back;
no window without partitions is used for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonagrid.operators import quantiles


def _with_stats(rows: DataFrame, **stats: Column) -> DataFrame:
    """Every row with corpus-wide statistics beside it (a single row, so broadcast)."""
    return rows.crossJoin(F.broadcast(rows.agg(*[c.alias(n) for n, c in stats.items()])))


def min_max(rows: DataFrame, value: str) -> DataFrame:
    """(x - min) / (max - min); null if constant."""
    out = _with_stats(rows, _lo=F.min(value), _hi=F.max(value))
    return out.withColumn("scaled", F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))).drop("_lo", "_hi")


def max_scaled(rows: DataFrame, value: str) -> DataFrame:
    """x / max of positive values, clipped to 0..1, with a status."""
    out = _with_stats(rows, _hi=F.max(F.when(F.col(value) > 0, F.col(value))))
    scaled = F.when(F.col("_hi").isNotNull() & F.col(value).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(value) / F.col("_hi"))))
    return out.withColumn("scaled", scaled).withColumn("status", F.when(F.col("scaled").isNull(), "missing").otherwise("ok")).drop("_hi")


def z_scores(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Population z-scores of some columns (z_*), and their weighted sum (index)."""
    stats = {f"_m_{c}": F.avg(c) for c in weights} | {f"_s_{c}": F.stddev_pop(c) for c in weights}
    out = _with_stats(rows, **stats)
    for c in weights:
        out = out.withColumn(f"z_{c}", F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")))
    total = sum((w * F.col(f"z_{c}") for c, w in weights.items()), F.lit(0.0))
    return out.withColumn("index", total).drop(*stats)


def robust_z(rows: DataFrame, value: str) -> DataFrame:
    """0.6745 (x - median) / MAD, two exact medians over counts of distinct values; null if the MAD is 0."""
    counts = quantiles.distinct_counts(rows.select(F.col(value).alias("_v")), [], "_v")
    middle = quantiles.exact_of_counts(counts, [], "_v", {"_median": 0.5})
    away = counts.crossJoin(F.broadcast(middle)).groupBy(F.abs(F.col("_v") - F.col("_median")).alias("_dev")).agg(F.sum("_n").alias("_n"))
    spread = quantiles.exact_of_counts(away, [], "_dev", {"_mad": 0.5})
    out = rows.crossJoin(F.broadcast(middle.crossJoin(F.broadcast(spread))))  # one row
    return out.withColumn("robust_z", F.when(F.col("_mad") > 0, 0.6745 * (F.col(value) - F.col("_median")) / F.col("_mad"))).drop("_median", "_mad")


def clipped_range(rows: DataFrame, value: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Position between two percentiles, clipped to 0..1."""
    out = quantiles.with_exact(rows, rows, [], value, {"_lo": low, "_hi": high})
    x = (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    return out.withColumn("scaled", F.when((F.col("_hi") > F.col("_lo")) & F.col(value).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))).drop("_lo", "_hi")


def log_range(rows: DataFrame, value: str, epsilon: float = 1e-12) -> DataFrame:
    """Position of ln x between ln min and ln max."""
    x = F.log(F.greatest(F.col(value), F.lit(epsilon)))
    return min_max(rows.withColumn("_ln", x), "_ln").drop("_ln")


def fences(cells: DataFrame, keys: list[str], value: str, multiplier: float = 1.5) -> DataFrame:
    """q1, q3 and fences per key, for keys with four values and a positive range."""
    sizes = cells.groupBy(*keys).agg(F.count(value).alias("_n"))
    q = quantiles.with_exact(sizes, cells, keys, value, {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return q.filter((F.col("_n") >= 4) & (iqr > 0)).select(*keys, "q1", "q3", (F.col("q1") - multiplier * iqr).alias("low"), (F.col("q3") + multiplier * iqr).alias("high"))


def outliers(cells: DataFrame, keys: list[str], value: str, label: str, most: int = 100, multiplier: float = 1.5) -> DataFrame:
    """Values outside their key's fences, the ``most`` farthest out of each key (a report)."""
    marks = fences(cells, keys, value, multiplier)
    out = cells.join(F.broadcast(marks), keys).filter((F.col(value) < F.col("low")) | (F.col(value) > F.col("high")))
    beyond = F.greatest(F.col("low") - F.col(value), F.col(value) - F.col("high"))
    order = Window.partitionBy(*keys).orderBy(F.desc(beyond), label)
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select(*keys, label, value, "rank")


def average_ranks(cells: DataFrame, keys: list[str], value: str, name: str = "rank") -> DataFrame:
    """Ranks from 1 with ties averaged, by distinct value: see :func:`quantiles.ranks`."""
    return cells.join(quantiles.ranks(cells, keys, value, name).drop("_n"), [*keys, value])


def extremes(rows: DataFrame, value: str, label: str, k: int = 5) -> DataFrame:
    """The k largest and k smallest rows (a report), with side and rank."""
    parts = []
    for side, order in (("top", F.desc(value)), ("bottom", F.asc(value))):
        best = rows.filter(F.col(value).isNotNull()).orderBy(order, label).limit(k)
        parts.append(best.withColumn("rank", F.row_number().over(Window.orderBy(order, label))).withColumn("side", F.lit(side)))
    return parts[0].unionByName(parts[1])
