"""Harmonic partials taken from the peaks of a spectrum.

Peaks are found by windows over a note's bins. Which orders' windows hold a peak follows from its
frequency, the windows lying on a regular series, so no join is needed; orders then take their
nearest peak in turn, a peak only once, by a fold over the note's few candidates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spectral_peaks(spectrum: DataFrame, above_db: float = 3.0, floor: float = 0.1, apart: int = 3) -> DataFrame:
    """note, bin, freq_hz, amp of peaks, refined by a parabola through the logarithms; freq_hz follows the local bin width.

    A peak is a bin above both neighbours (a plateau's first bin, if it falls on the other side),
    ``above_db`` over the note's floor (a quantile of its bins), and the highest of those within
    less than ``apart`` bins (ties: the lower bin). The outermost bins are none. Null amplitudes count as 0.
    """
    order = Window.partitionBy("note").orderBy("bin")
    y = F.log10(F.greatest(F.coalesce("amp", F.lit(0.0)), F.lit(1e-12)))
    rows = spectrum.select("note", "bin", "freq_hz", F.coalesce(F.col("amp").cast("double"), F.lit(0.0)).alias("amp"), y.alias("y"))
    sides = rows.withColumns({n: f(c).over(order) for n, f, c in (("l", F.lag, "y"), ("r", F.lead, "y"), ("before", F.lag, "freq_hz"), ("after", F.lead, "freq_hz"))})
    floors = spectrum.groupBy("note").agg(F.percentile(F.coalesce(F.col("amp").cast("double"), F.lit(0.0)), floor).alias("floor"))
    tops = sides.filter("y > l AND y >= r").join(floors, "note").filter(F.col("amp") >= F.col("floor") * 10 ** (above_db / 20))
    near = Window.partitionBy("note").orderBy("bin").rangeBetween(-(apart - 1), apart - 1)
    highest = F.max(F.struct(F.col("amp"), (-F.col("bin")).alias("bin"))).over(near)
    peaks = tops.withColumn("top", highest).filter(F.col("top.bin") == -F.col("bin"))
    bend = F.col("l") - 2 * F.col("y") + F.col("r")
    shift = F.when(F.abs(bend) > 2e-10, F.greatest(F.least(0.5 * (F.col("l") - F.col("r")) / bend, F.lit(1.0)), F.lit(-1.0))).otherwise(0.0)
    found = peaks.withColumn("shift", shift)
    level = F.col("y") - 0.25 * (F.col("l") - F.col("r")) * F.col("shift")
    return found.select("note", "bin", (F.col("freq_hz") + F.col("shift") * (F.col("after") - F.col("before")) / 2).alias("freq_hz"), F.pow(F.lit(10.0), level).alias("amp"))


def harmonic_partials(peaks: DataFrame, fundamentals: DataFrame, cents: float = 20.0) -> DataFrame:
    """note, n, bin, freq_hz, amp, off_hz: for each order, lowest first, the nearest peak of its window that no lower order took.

    A window reaches ``cents`` above its order's frequency, and as many Hz below. Ties go to the
    lower bin. Notes without a fundamental above 0 have no partial; all orders up to the highest peak count.
    """
    r = 2 ** (cents / 1200) - 1
    met = peaks.join(fundamentals.select("note", F.col("f0_hz").cast("double").alias("f0")).filter("f0 > 0"), "note")
    per = F.col("freq_hz") / F.col("f0")
    low, high = F.greatest(F.ceil(per / (1 + r) - 1e-9), F.lit(1)), F.floor(per / (1 - r) + 1e-9)
    orders = met.withColumn("n", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))))
    off = F.abs(F.col("freq_hz") - F.col("n") * F.col("f0"))
    inside = orders.withColumn("off", off).filter(F.col("off") <= F.col("n") * F.col("f0") * r)
    one = F.struct("n", F.round("off", 9).alias("off"), "bin", "freq_hz", "amp")
    lists = inside.groupBy("note").agg(F.array_sort(F.collect_list(one)).alias("found"))
    none = F.filter("found", lambda x: F.lit(False))
    start = F.struct(F.lit(0).cast("long").alias("last"), F.transform(none, lambda x: x["bin"]).alias("used"), none.alias("taken"))

    def step(acc, x):
        free = (x["n"] > acc["last"]) & ~F.array_contains(acc["used"], x["bin"])
        return F.when(free, F.struct(x["n"].alias("last"), F.concat(acc["used"], F.array(x["bin"])).alias("used"), F.concat(acc["taken"], F.array(x)).alias("taken"))).otherwise(acc)

    taken = lists.select("note", F.explode(F.aggregate("found", start, step, lambda acc: acc["taken"])).alias("x"))
    return taken.select("note", "x.n", "x.bin", "x.freq_hz", "x.amp", F.col("x.off").alias("off_hz"))


def peak_energy(peaks: DataFrame, partials: DataFrame, below_hz: float) -> DataFrame:
    """Per note: peaks, partials, and the shares of peak energy that are harmonic, below ``below_hz``, and neither; and orders matched of those expected.

    A harmonic peak counts as such wherever it lies. Expected orders end at the highest peak.
    """
    marks = partials.select("note", "bin", "n")
    rows = peaks.join(marks, ["note", "bin"], "left")
    kind = F.when(F.col("n").isNotNull(), "h").when(F.col("freq_hz") < below_hz, "low").otherwise("other")
    e = F.col("amp") * F.col("amp")
    out = rows.withColumn("kind", kind).groupBy("note").agg(F.count("*").alias("peaks"), F.count("n").alias("partials"), F.sum(e).alias("energy"), *[F.coalesce(F.sum(F.when(F.col("kind") == k, e)), F.lit(0.0)).alias(k) for k in ("h", "low", "other")])
    return out.select("note", "peaks", "partials", *[F.try_divide(k, "energy").alias(n) for k, n in (("h", "harmonic_share"), ("low", "low_share"), ("other", "other_share"))])
