"""Frames: peaks over time, persistence, envelopes and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frame_peaks(frames: DataFrame, above_median_db: float = 6.0) -> DataFrame:
    """Strict local maxima of each frame (note, frame) that stand above its median level."""
    order = Window.partitionBy("note", "frame").orderBy("bin")
    rows = frames.withColumn("_l", F.lag("db").over(order)).withColumn("_r", F.lead("db").over(order)).withColumn("_m", F.percentile("db", 0.5).over(Window.partitionBy("note", "frame")))
    return rows.filter((F.col("db") > F.col("_l")) & (F.col("db") > F.col("_r")) & (F.col("db") >= F.col("_m") + above_median_db)).drop("_l", "_r", "_m")


def persistence(partials: DataFrame, peaks: DataFrame, frames: int, tolerance_hz: float) -> DataFrame:
    """Share of frames in which a partial has a peak within the tolerance; partials and peaks meet by cells."""
    cell = F.floor(F.col("peak_hz") / tolerance_hz)
    spread = peaks.select(F.col("note").alias("_note"), "frame", F.col("freq_hz").alias("peak_hz")).withColumn("_cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    left = partials.withColumn("_cell", F.floor(F.col("freq_hz") / tolerance_hz))
    spread = spread.withColumnRenamed("_cell", "_peak_cell")
    on = (left["note"] == spread["_note"]) & (left["_cell"] == spread["_peak_cell"]) & (F.abs(left["freq_hz"] - spread["peak_hz"]) <= tolerance_hz)
    met = left.join(spread, on, "left")
    return met.groupBy(left["note"], left["freq_hz"]).agg((F.countDistinct("frame") / frames).alias("persistence"))


def segments(samples: DataFrame, key: str, time: str, gap_seconds: float) -> DataFrame:
    """Runs of samples without a gap (gaps and islands): start, end and size of each."""
    order = Window.partitionBy(key).orderBy(time)
    since = F.col(time).cast("double") - F.lag(F.col(time).cast("double")).over(order)
    rows = samples.withColumn("_new", F.coalesce((since > gap_seconds).cast("int"), F.lit(1)))
    rows = rows.withColumn("segment", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "segment").agg(F.min(time).alias("started"), F.max(time).alias("ended"), F.count("*").alias("samples"))


def hopped_activity(events: DataFrame, time: str, key: str, size: str, hop: str) -> DataFrame:
    """Per key: windows hit, of windows that slide by ``hop`` over ``size``, and mean samples a window."""
    hits = events.groupBy(key, F.window(time, size, hop).alias("w")).agg(F.count("*").alias("n"))
    return hits.groupBy(key).agg(F.count("*").alias("windows"), F.sum("n").alias("samples"))


def rolling_floor(spectrum: DataFrame, quantile: float = 0.15, multiplier: float = 1.3, reach: int = 8) -> DataFrame:
    """Power above ``multiplier`` times a rolling quantile over neighbouring bins, 0 at least."""
    p = F.col("amp") * F.col("amp")
    order = Window.partitionBy("note").orderBy("bin").rowsBetween(-reach, reach)
    floor = multiplier * F.percentile("p", quantile).over(order)
    return spectrum.withColumn("p", p).withColumn("floor", floor).withColumn("gated", F.greatest(F.lit(0.0), F.col("p") - F.col("floor")))


def cfar(spectrum: DataFrame, false_alarms: float = 1e-2, guard: int = 2, train: int = 64, trim: float = 0.25) -> DataFrame:
    """Cell-averaging detection: power against alpha x mean of training cells without their largest quarter.

    Training cells lie beyond ``guard`` bins on both sides; alpha = N (Pfa^(-1/N) - 1).
    """
    p = F.col("amp") * F.col("amp")
    order = Window.partitionBy("note").orderBy("bin")
    left = F.collect_list("p").over(order.rowsBetween(-guard - train, -guard - 1))
    right = F.collect_list("p").over(order.rowsBetween(guard + 1, guard + train))
    rows = spectrum.withColumn("p", p).withColumn("cells", F.array_sort(F.concat(left, right)))
    kept = F.slice("cells", 1, F.greatest(F.lit(1), F.floor(F.size("cells") * (1 - trim)).cast("int")))
    rows = rows.withColumn("kept", kept).withColumn("n", F.size("kept").cast("double"))
    mean = F.aggregate("kept", F.lit(0.0), lambda a, x: a + x) / F.col("n")
    alpha = F.col("n") * (F.pow(F.lit(false_alarms), -1 / F.col("n")) - 1)
    rows = rows.withColumn("threshold", alpha * mean)
    margin = F.when((F.col("p") > 0) & (F.col("threshold") > 0), 10 * F.log10(F.col("p") / F.col("threshold")))
    return rows.withColumn("margin_db", margin).withColumn("detected", F.col("p") >= F.col("threshold")).drop("cells", "kept", "n")


def local_maxima(spectrum: DataFrame) -> DataFrame:
    """Strict local maxima with a parabola through their logarithms: refined bin position and level."""
    order = Window.partitionBy("note").orderBy("bin")
    y = F.log(F.greatest(F.col("amp"), F.lit(1e-12)))
    rows = spectrum.withColumn("y", y).withColumn("l", F.lag("y").over(order)).withColumn("r", F.lead("y").over(order))
    peaks = rows.filter("y > l and y > r")
    shift = 0.5 * (F.col("l") - F.col("r")) / (F.col("l") - 2 * F.col("y") + F.col("r"))
    return peaks.withColumn("shift", shift).select("note", "bin", (F.col("bin") + F.col("shift")).alias("position"), F.exp(F.col("y") - 0.25 * (F.col("l") - F.col("r")) * F.col("shift")).alias("height"))


def prominence(spectrum: DataFrame, reach: int = 6) -> DataFrame:
    """Level in dB over the higher of the two side minima within ``reach`` bins, for strict local maxima."""
    order = Window.partitionBy("note").orderBy("bin")
    db = 20 * F.log10(F.greatest(F.col("amp"), F.lit(1e-12)))
    rows = spectrum.withColumn("db", db).withColumn("l", F.lag("db").over(order)).withColumn("r", F.lead("db").over(order))
    rows = rows.withColumn("lo", F.min("db").over(order.rowsBetween(-reach, -1))).withColumn("hi", F.min("db").over(order.rowsBetween(1, reach)))
    return rows.filter("db > l and db > r").select("note", "bin", (F.col("db") - F.greatest("lo", "hi")).alias("prominence_db"))
