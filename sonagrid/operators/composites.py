"""Scores composed of several aggregates of a note, and how stable their ranks are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonagrid.functions import phi as weights
from sonagrid.functions.guards import clip
from sonagrid.functions.sums import rounded_sum
from sonagrid.operators import quantiles
from sonagrid.operators.density import compartment_scores
from sonagrid.operators.statistics import spearman_all


def combined(h: Column, i: Column, alpha: float = 0.7, beta: float = 0.3, keep_range: bool = True) -> Column:
    """Weighted mix of two densities, of their log1p (taken back by expm1) if ``keep_range``."""
    a, b = alpha / (alpha + beta), beta / (alpha + beta)
    return F.expm1(a * F.log1p(h) + b * F.log1p(i)) if keep_range else a * h + b * i


def richness(components: DataFrame, most: float = 100.0) -> DataFrame:
    """0.8 min(1, N / most) + 0.2 tanh(geometric mean amplitude) of harmonic components."""
    rows = components.filter((F.col("comp") == "H") & (F.col("amp") > 0))
    return rows.groupBy("note").agg((0.8 * F.least(F.lit(1.0), F.count("*") / most) + 0.2 * F.tanh(F.exp(F.avg(F.log("amp"))))).alias("richness"))


def level_density(components: DataFrame, comp: str, threshold_db: float, expected: float) -> DataFrame:
    """clip(0.8 count(level > threshold) / expected + 0.2 tanh(mean amplitude above it), 0, 1)."""
    loud = 20 * F.log10(F.greatest("amp", F.lit(1e-12))) > threshold_db
    rows = components.filter(F.col("comp") == comp)
    value = 0.8 * F.count_if(loud) / expected + 0.2 * F.tanh(F.coalesce(F.avg(F.when(loud, F.col("amp"))), F.lit(0.0)))
    return rows.groupBy("note").agg(clip(value, 0.0, 1.0).alias("density"))


def capacity(components: DataFrame, ceiling_hz: float) -> DataFrame:
    """Slots below a ceiling, harmonics found, and the fill as a power of their ratio."""
    slots = F.floor(F.lit(ceiling_hz) / F.max("f0_hz"))
    out = components.groupBy("note").agg(slots.cast("long").alias("slots"), F.countDistinct(F.when(F.col("comp") == "H", F.col("n"))).alias("found"))
    return out.withColumn("fill", F.pow(F.least(F.lit(1.0), F.try_divide("found", "slots")), F.lit(0.5)))


def completeness(components: DataFrame) -> DataFrame:
    """Share of orders 1 .. highest that are there, and the longest run of missing ones."""
    orders = components.filter(F.col("comp") == "H").groupBy("note").agg(F.collect_set("n").alias("have"), F.max("n").alias("top"))
    slots = orders.select("note", "have", "top", F.explode(F.sequence(F.lit(1).cast("long"), F.col("top"))).alias("n"))
    marks = slots.withColumn("there", F.array_contains("have", F.col("n")))
    order = Window.partitionBy("note").orderBy("n")
    runs = marks.withColumn("part", F.sum(F.col("there").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    gaps = runs.groupBy("note", "part").agg(F.count_if(~F.col("there")).alias("gap"), F.count_if("there").alias("there"))
    return gaps.groupBy("note").agg((F.sum("there") / F.sum(F.col("gap") + F.col("there"))).alias("completeness"), F.max("gap").alias("longest_gap"))


def band_floor(spectrum: DataFrame, edges: tuple[float, ...] = (0, 200, 1000, 5000, 20000), quantile: float = 0.2) -> DataFrame:
    """A low quantile of the level in each fixed band."""
    band = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        band = F.when((F.col("freq_hz") >= edges[i]) & (F.col("freq_hz") < edges[i + 1]), i).otherwise(band)
    db = 20 * F.log10(F.greatest("amp", F.lit(1e-12)))
    return spectrum.withColumn("band", band).filter("band is not null").groupBy("note", "band").agg(F.percentile(db, quantile).alias("floor_db"), F.count("*").alias("bins"))


def rank_stability(components: DataFrame, alphas: tuple[float, ...] = (0.25, 0.5, 1.0)) -> DataFrame:
    """Spearman's rho of note scores between balance exponents; compartments are aggregated once."""
    parts = compartment_scores(components)
    weighted = F.col("share") * F.col("mass")
    scores = parts.groupBy("note").agg(*[F.round(F.sum(weighted * F.pow("penalty", F.lit(a))), 9).alias(f"s{i}") for i, a in enumerate(alphas)])
    value = F.create_map(*(F.lit(x) for i, a in enumerate(alphas) for x in (f"s{i}", a)))
    return spearman_all(scores, [f"s{i}" for i in range(len(alphas))]).select(value[F.col("a")].alias("a"), value[F.col("b")].alias("b"), "rho", "n")


def phi_stability(components: DataFrame, names: tuple[str, ...] = ("linear", "sqrt", "log")) -> DataFrame:
    """Spearman's rho of note sums between weight functions; all sums in one pass.

    The sums don't depend on the order in which components arrive: ranks are joined back by them.
    """
    scores = components.groupBy("note").agg(*[rounded_sum(weights.phi(n, F.col("amp"))).alias(n) for n in names])
    return spearman_all(scores, list(names))


def isolation(rows: DataFrame, value: str, label: str, quantile_step: float = 0.01) -> DataFrame:
    """A histogram isolation score: -log10 of the share of rows in a value's bin, bins between two fences."""
    stats = quantiles.exact(rows, [], value, {"_lo": quantile_step, "_hi": 1 - quantile_step})
    width = (F.col("_hi") - F.col("_lo")) / 50
    marked = rows.crossJoin(F.broadcast(stats)).withColumn("bin", F.when(width > 0, F.floor((F.col(value) - F.col("_lo")) / width)))
    sizes = marked.groupBy("bin").agg(F.count("*").alias("_n"))
    total = rows.agg(F.count("*").alias("_all"))
    return marked.join(F.broadcast(sizes), "bin").crossJoin(F.broadcast(total)).select(label, (-F.log10(F.col("_n") / F.col("_all"))).alias("isolation"))


