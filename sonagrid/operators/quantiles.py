"""Exact quantiles and ranks of any number of values, without a buffer that holds all values of a key.

Distinct values are counted first. One row of approximate quantiles over all of them cuts the number
line into ranges, each of which holds about 1 / ranges of the distinct values of *all* keys together;
so a range of one key is never larger than that, however the values are spread over keys. Counts per
(key, range) tell in which range a rank lies, and only such ranges are ordered, each on its own.

The cuts stay inside the plan (one broadcast row); nothing comes to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 1000


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """The keys are equal, null being equal to null."""
    return reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in keys), F.lit(True))


def ranged(counts: DataFrame, value: str, ranges: int = RANGES) -> DataFrame:
    """``counts`` (a row a distinct value) with ``_range``, the number of cuts not above the value.

    Equal values always share a range and ranges ascend with the values. The cuts read ``_n`` too (it is
    never 0), so that they need the same columns as the rest and Spark shuffles the counts once.
    """
    at, quoted = ", ".join(f"{i / ranges!r}D" for i in range(1, ranges)), value.replace("`", "``")
    found = F.expr(f"percentile_approx(CASE WHEN _n > 0 THEN `{quoted}` END, array({at}), {10 * ranges})")  # as text: a call a share is slow
    cuts = counts.agg(F.array_distinct(F.coalesce(found, F.array().cast("array<double>"))).alias("_cuts"))
    size = F.size("_cuts")
    steps = F.array(*(F.lit(1 << x) for x in reversed(range(ranges.bit_length()))))
    below = lambda n, step: (n + step <= size) & (F.get("_cuts", n + step - 1) <= F.col(value))
    number = F.aggregate(steps, F.lit(0), lambda n, step: F.when(below(n, step), n + step).otherwise(n))
    return counts.crossJoin(F.broadcast(cuts)).withColumn("_range", number).drop("_cuts")  # one row


def distinct_counts(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value as a double, ``_n``) of every distinct value of a key; null and NaN don't count, -0.0 is 0.0."""
    good = cells.select(*keys, F.col(value).cast("double").alias(value)).filter(F.col(value).isNotNull() & ~F.isnan(value))
    return good.groupBy(*keys, value).agg(F.count("*").alias("_n"))


def _starts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ``_range``, ``_start``, ``_size``, ``_rows``): rows below a range, in it, and of its key; at most ``ranges`` rows a key."""
    sums = counts.groupBy(*keys, "_range").agg(F.sum("_n").alias("_size"))
    of = Window.partitionBy(*keys)
    upto = F.sum("_size").over(of.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
    return sums.withColumn("_start", upto - F.col("_size")).withColumn("_rows", F.sum("_size").over(of))


def exact(cells: DataFrame, keys: list[str], value: str, of: dict[str, float], ranges: int = RANGES) -> DataFrame:
    """The quantiles ``of`` (name -> share) of every key, interpolated between neighbours; one row a key.

    Null and NaN don't count; a key without values has no row (without keys: one row of nulls).
    Null keys are a key. Equal to ``percentile``, which holds all distinct values of a key at once.
    """
    return exact_of_counts(distinct_counts(cells, keys, value), keys, value, of, ranges)


def exact_of_counts(counts: DataFrame, keys: list[str], value: str, of: dict[str, float], ranges: int = RANGES) -> DataFrame:
    """:func:`exact` of values that are counted already (keys, value, ``_n``)."""
    counts = ranged(counts, value, ranges)
    starts = _starts(counts, keys)
    place = {n: F.lit(float(q)) * (F.col("_rows") - 1) for n, q in of.items()}
    inside = lambda rank, first, size: (rank >= first) & (rank < first + size)
    needed = [inside(end(p), F.col("_start"), F.col("_size")) for p in place.values() for end in (F.floor, F.ceil)]
    targets = starts.filter(reduce(lambda a, b: a | b, needed)).alias("t")
    counts = counts.alias("c")
    near = counts.join(targets, _same(counts, targets, [*keys, "_range"])).select(*(F.col(f"c.{k}").alias(k) for k in keys), F.col(f"c.{value}").alias("_v"), "c._n", "c._range", "t._start", "t._rows")
    within = Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_first", F.col("_start") + F.sum("_n").over(within) - F.col("_n"))
    ends = [F.max(F.when(inside(end(p), F.col("_first"), F.col("_n")), F.col("_v"))).alias(f"_{name}_{side}") for name, p in place.items() for side, end in (("lo", F.floor), ("hi", F.ceil))]
    found = near.groupBy(*keys).agg(F.max("_rows").alias("_rows"), *ends)

    def between(name: str) -> Column:
        p, lo, hi = place[name], F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        return F.when(F.floor(p) == F.ceil(p), lo).otherwise((F.ceil(p) - p) * lo + (p - F.floor(p)) * hi)

    return found.select(*keys, *(between(n).alias(n) for n in of))


def with_exact(stats: DataFrame, cells: DataFrame, keys: list[str], value: str, of: dict[str, float]) -> DataFrame:
    """``stats`` (a row a key) with the quantiles ``of`` beside it; null where a key has no values."""
    found = exact(cells, keys, value, of)
    if not keys:
        return stats.crossJoin(F.broadcast(found))  # one row
    stats, found = stats.alias("s"), found.alias("q")
    return stats.join(found, _same(stats, found, keys), "left").select("s.*", *(F.col(f"q.{n}").alias(n) for n in of))


def ranks(cells: DataFrame, keys: list[str], value: str, name: str = "rank") -> DataFrame:
    """(keys, value, average rank from 1, count ``_n``) of every distinct value of a key; no task orders all of them."""
    counts = ranged(distinct_counts(cells, keys, value), value)
    starts = _starts(counts, keys).select(*keys, "_range", "_start")
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("_upto", upto).alias("c")
    starts = starts.alias("t")
    rank = F.col("t._start") + F.col("c._upto") - (F.col("c._n") - 1) / 2
    return placed.join(starts if keys else F.broadcast(starts), _same(placed, starts, [*keys, "_range"])).select(*(F.col(f"c.{k}").alias(k) for k in keys), F.col(f"c.{value}").alias(value), rank.alias(name), "c._n")


def ranks_among(cells: DataFrame, value: str, mask: str, among: dict[str, int]) -> DataFrame:
    """(value, mask) and, for each of ``among``, the value's average rank among the rows whose mask has all its bits (null outside of them).

    One ordering of the distinct values serves all these sets of rows.
    """
    counts = ranged(distinct_counts(cells, [mask], value), value)
    within = {n: F.col(mask).bitwiseAND(bits) == bits for n, bits in among.items()}
    counted = {n: F.coalesce(F.sum(F.when(c, F.col("_n"))), F.lit(0)) for n, c in within.items()}
    sums = counts.groupBy("_range").agg(*(c.alias(f"_size_{n}") for n, c in counted.items()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most ``RANGES`` rows
    starts = sums.select("_range", *(F.coalesce(F.sum(f"_size_{n}").over(before), F.lit(0)).alias(f"_start_{n}") for n in among))
    of = Window.partitionBy("_range").orderBy(value)
    upto, alike = of.rangeBetween(Window.unboundedPreceding, 0), Window.partitionBy("_range", value)
    sum_over = lambda c, w: F.sum(F.when(c, F.col("_n"))).over(w)
    placed = counts.select("_range", value, mask, *(f(c).alias(f"{k}{n}") for n, c in within.items() for k, f in (("_upto_", lambda c: sum_over(c, upto)), ("_alike_", lambda c: sum_over(c, alike)))))
    rank = {n: F.when(c, F.col(f"_start_{n}") + F.col(f"_upto_{n}") - (F.col(f"_alike_{n}") - 1) / 2) for n, c in within.items()}
    return placed.join(F.broadcast(starts), "_range").select(value, mask, *(r.alias(n) for n, r in rank.items()))
