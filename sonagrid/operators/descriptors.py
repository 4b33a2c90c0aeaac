"""Spectral descriptors of grouped spectra (note, bin, freq_hz, amp)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonagrid.functions.phi import participation
from sonagrid.functions.scales import bark, erb_rate


def moments(spectrum: DataFrame) -> DataFrame:
    """Centroid, spread, skewness and kurtosis of amplitude shares, from power sums in one pass."""
    a, f = F.col("amp"), F.col("freq_hz")
    sums = spectrum.groupBy("note").agg(F.sum(a).alias("m0"), *[F.sum(a * F.pow(f, F.lit(float(k)))).alias(f"m{k}") for k in (1, 2, 3, 4)])
    c, m2, m3, m4 = (F.try_divide(f"m{k}", "m0") for k in (1, 2, 3, 4))
    rows = sums.select("note", c.alias("c"), m2.alias("m2"), m3.alias("m3"), m4.alias("m4"))
    c, m2, m3, m4 = (F.col(x) for x in ("c", "m2", "m3", "m4"))
    var = F.greatest(m2 - c * c, F.lit(0.0))
    third = m3 - 3 * c * m2 + 2 * c * c * c
    fourth = m4 - 4 * c * m3 + 6 * c * c * m2 - 3 * c * c * c * c
    return rows.select("note", c.alias("centroid_hz"), F.sqrt(var).alias("spread_hz"), F.try_divide(third, F.pow(var, F.lit(1.5))).alias("skewness"), F.try_divide(fourth, var * var).alias("kurtosis"))


def rolloff(spectrum: DataFrame, shares: tuple[float, ...] = (0.85, 0.95)) -> DataFrame:
    """The lowest frequency up to which the power reaches each share of the total."""
    p = F.col("amp") * F.col("amp")
    order = Window.partitionBy("note").orderBy("freq_hz").rangeBetween(Window.unboundedPreceding, 0)
    rows = spectrum.withColumn("upto", F.sum(p).over(order)).withColumn("all", F.sum(p).over(Window.partitionBy("note")))
    return rows.groupBy("note").agg(*[F.min(F.when(F.col("upto") >= s * F.col("all") - 1e-12, F.col("freq_hz"))).alias(f"rolloff_{round(100 * s)}") for s in shares])


def irregularity(spectrum: DataFrame) -> DataFrame:
    """Sum of steps between neighbouring amplitudes over the sum of amplitudes."""
    following = F.lead("amp").over(Window.partitionBy("note").orderBy("freq_hz", "amp"))
    rows = spectrum.withColumn("step", F.abs(following - F.col("amp")))
    return rows.groupBy("note").agg(F.try_divide(F.coalesce(F.sum("step"), F.lit(0.0)), F.sum("amp")).alias("irregularity"))


def tristimulus(spectrum: DataFrame) -> DataFrame:
    """Shares of the first, the second to fourth, and the other partials in the amplitude sum."""
    rank = F.row_number().over(Window.partitionBy("note").orderBy("freq_hz", "amp"))
    rows = spectrum.withColumn("k", rank)
    total = F.sum("amp")
    part = lambda c: F.try_divide(F.sum(F.when(c, F.col("amp")).otherwise(0.0)), total)
    return rows.groupBy("note").agg(part(F.col("k") == 1).alias("t1"), part(F.col("k").between(2, 4)).alias("t2"), part(F.col("k") >= 5).alias("t3"))


def flatness_entropy(spectrum: DataFrame) -> DataFrame:
    """Geometric over arithmetic mean of positive powers, and Shannon entropy over its maximum."""
    p = F.when(F.col("amp") > 0, F.col("amp") * F.col("amp"))
    rows = spectrum.withColumn("p", p).withColumn("q", F.try_divide(p, F.sum(p).over(Window.partitionBy("note"))))
    return rows.groupBy("note").agg(F.try_divide(F.exp(F.avg(F.log("p"))), F.avg("p")).alias("flatness"), F.when(F.count("q") > 1, -F.sum(F.col("q") * F.log("q")) / F.log(F.count("q"))).otherwise(0.0).alias("entropy"))


def erb_density(spectrum: DataFrame) -> DataFrame:
    """Effective number of occupied ERB bands by power."""
    bands = spectrum.groupBy("note", F.floor(erb_rate(F.col("freq_hz"))).alias("band")).agg(F.sum(F.col("amp") * F.col("amp")).alias("p"))
    return bands.groupBy("note").agg(participation(F.col("p")).alias("erb_density"), F.count("*").alias("bands"))


def bark_occupancy(spectrum: DataFrame) -> DataFrame:
    """0.6 x share of 25 Bark bands with energy + 0.4 x their entropy over its maximum, triangular bands."""
    z = bark(F.col("freq_hz"))
    rows = spectrum.select("note", z.alias("z"), (F.col("amp") * F.col("amp")).alias("p"))
    lower = F.floor("z")
    near = rows.select("note", F.explode(F.array(*[F.struct((lower + i).alias("band"), (F.col("p") * F.greatest(F.lit(0.0), 1 - F.abs(F.col("z") - (lower + i)))).alias("e")) for i in (0, 1)])).alias("x")).select("note", "x.band", "x.e")
    bands = near.filter(F.col("band").between(0, 24)).groupBy("note", "band").agg(F.sum("e").alias("e")).filter("e > 0")
    q = F.try_divide(F.col("e"), F.sum("e").over(Window.partitionBy("note")))
    out = bands.withColumn("q", q).groupBy("note").agg((0.6 * F.count("*") / 25 + 0.4 * F.when(F.count("*") > 1, -F.sum(F.col("q") * F.log("q")) / F.log(F.count("*"))).otherwise(0.0)).alias("perceptual_density"))
    return out


def concentration(spectrum: DataFrame, top: int = 5) -> DataFrame:
    """Share of the ``top`` largest amplitudes, and 1 - share of bins above 1 % of the largest."""
    order = Window.partitionBy("note").orderBy(F.desc("amp"), "freq_hz")
    rows = spectrum.withColumn("k", F.row_number().over(order)).withColumn("most", F.max("amp").over(Window.partitionBy("note")))
    return rows.groupBy("note").agg(F.try_divide(F.sum(F.when(F.col("k") <= top, F.col("amp")).otherwise(0.0)), F.sum("amp")).alias("concentration"), (1 - F.avg((F.col("amp") > 0.01 * F.col("most")).cast("double"))).alias("sparsity"))
