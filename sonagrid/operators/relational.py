"""The relational layer: merges with coalescing, deduplication, diffs, gates and coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_coalesce(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left merge that keeps left's rows: right fills the nulls of shared columns and adds its own.

    right must have one row a key (see :func:`violating_keys`).
    """
    shared = [c for c in right.columns if c in left.columns and c not in keys]
    extra = [c for c in right.columns if c not in left.columns]
    other = right.select(*keys, *[F.col(c).alias(f"{c}_y") for c in shared], *extra)
    rows = left.join(other, keys, "left")
    return rows.select(*[F.coalesce(c, f"{c}_y").alias(c) if c in shared else F.col(c) for c in left.columns], *extra)


def violating_keys(right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that would multiply rows of a many-to-one merge."""
    return right.groupBy(*keys).agg(F.count("*").alias("rows")).filter("rows > 1")


def require_unique(right: DataFrame, keys: list[str]) -> DataFrame:
    """``right``, or an error if a key repeats (the many-to-one contract, fail closed)."""
    if not violating_keys(right, keys).isEmpty():
        raise ValueError(f"keys {keys} aren't unique")
    return right


def merge_keys(left: DataFrame, right: DataFrame, exact: str, fallback: str) -> list[str]:
    """exact if it is non-blank and unique on both sides and right covers left, else fallback."""
    if exact not in left.columns or exact not in right.columns:
        return [fallback]
    blank = F.col(exact).isNull() | (F.trim(F.col(exact).cast("string")) == "")
    for side in (left, right):
        if not side.filter(blank).isEmpty() or not violating_keys(side, [exact]).isEmpty():
            return [fallback]
    return [exact] if left.join(right, [exact], "left_anti").isEmpty() else [fallback]


def best_row(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in a total order."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_k = 1").drop("_k")


def last_non_null(rows: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """Per key the last non-null value of each column; null keys are dropped."""
    kept = rows.dropna(subset=keys)
    return kept.groupBy(*keys).agg(*[F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns])


def full_diff(current: DataFrame, baseline: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer comparison: both values, delta, relative delta in per cent, and where the row is."""
    a = current.select(*keys, F.col(value).alias("current"), F.lit(True).alias("_a"))
    b = baseline.select(*keys, F.col(value).alias("baseline"), F.lit(True).alias("_b"))
    rows = a.join(b, keys, "full_outer")
    side = F.when(F.col("_a").isNull(), "baseline_only").when(F.col("_b").isNull(), "current_only").otherwise("both")
    delta = F.col("current") - F.col("baseline")
    return rows.select(*keys, "current", "baseline", delta.alias("delta"), F.when(F.col("baseline") != 0, 100 * delta / F.abs("baseline")).alias("percent"), side.alias("side"))


def diff_summary(diff: DataFrame, threshold: float) -> DataFrame:
    """Rows, rows over the threshold, largest size of a change in per cent, rows on one side only."""
    return diff.agg(F.count("*").alias("rows"), F.count_if(F.abs("percent") > threshold).alias("over"), F.max(F.abs("percent")).alias("largest"), F.count_if(F.col("side") != "both").alias("one_sided"))


def coverage(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Long table: metric, non-null count, fraction; one scan for all columns."""
    total = F.count("*")
    wide = rows.agg(total.alias("_n"), *[F.count(c).alias(c) for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("present"), F.try_divide(F.col(c), F.col("_n")).alias("fraction")) for c in columns])
    return wide.select(F.explode(cells).alias("x")).select("x.*")


def missing_summary(rows: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Per metric: nulls, their fraction, and the smallest label with one."""
    wide = rows.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"m_{c}") for c in columns], *[F.min(F.when(F.col(c).isNull(), F.col(label))).alias(f"f_{c}") for c in columns])
    cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"m_{c}").alias("missing"), F.try_divide(F.col(f"m_{c}"), F.col("_n")).alias("fraction"), F.col(f"f_{c}").alias("first_label")) for c in columns])
    return wide.select(F.explode(cells).alias("x")).select("x.*")


def long_form(rows: DataFrame, keys: list[str], columns: list[str], names: tuple[str, str] = ("metric", "value")) -> DataFrame:
    """Unpivot without null values."""
    return rows.unpivot(keys, columns, *names).filter(F.col(names[1]).isNotNull())


def near_constant(rows: DataFrame, columns: list[str], threshold: float = 1e-9) -> DataFrame:
    """Metrics whose standard deviation is at most the threshold, or with fewer than two values."""
    cells = long_form(rows, [], columns)
    stats = cells.groupBy("metric").agg(F.stddev_samp("value").alias("std"), F.countDistinct("value").alias("distinct"))
    return stats.filter(F.col("std").isNull() | (F.col("std") <= threshold)).select("metric", "distinct")


def drop_dead_columns(rows: DataFrame, protected: tuple[str, ...] = ()) -> DataFrame:
    """Without columns that are all null or blank (all-zero columns stay); one scan decides."""
    filled = rows.agg(*[F.count_if(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")).alias(c) for c in rows.columns]).first()
    return rows.select(*[c for c in rows.columns if c in protected or filled[c]])


def drop_equal_columns(rows: DataFrame) -> DataFrame:
    """Without columns c_2 that equal c in every row."""
    pairs = [(c, c[:-2]) for c in rows.columns if c.endswith("_2") and c[:-2] in rows.columns]
    if not pairs:
        return rows
    same = rows.agg(*[F.bool_and(F.col(a).eqNullSafe(F.col(b))).alias(a) for a, b in pairs]).first()
    return rows.drop(*[a for a, _ in pairs if same[a]])


def with_aliases(rows: DataFrame, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """Canonical columns from the first non-null of their present aliases; missing ones are null."""
    have = set(rows.columns)
    picked = {}
    for name, aliases in names.items():
        found = [F.col(f"`{a}`") for a in (name, *aliases) if a in have]
        picked[name] = F.coalesce(*found) if found else F.lit(None).cast("double")
    used = {a for aliases in names.values() for a in aliases} | set(names)
    return rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in used], *[c.alias(n) for n, c in picked.items()])


def contract_violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """How many rows break each named check (null counts as a breach)."""
    wide = rows.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in checks])).alias("x")).select("x.*")


def enforce(violations: DataFrame) -> None:
    """Raise if a check of :func:`contract_violations` is broken."""
    broken = [(r["check"], r["violations"]) for r in violations.filter("violations > 0").collect()]  # one row a check
    if broken:
        raise ValueError(f"broken checks: {broken}")


def single_source(tables: list[DataFrame], keys: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """Keys whose value differs between tables by more than the tolerance."""
    stacked = reduce(DataFrame.unionByName, [t.select(*keys, value) for t in tables])
    return stacked.groupBy(*keys).agg((F.max(value) - F.min(value)).alias("gap")).filter(F.col("gap") > tolerance)
