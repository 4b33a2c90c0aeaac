"""Gates and summaries that decide what of a note, or of a corpus, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonagrid.functions import resolution
from sonagrid.operators.ranges import covered_length


def grid_step(spectrum: DataFrame, sample_rate: float, n_fft: int) -> DataFrame:
    """A note's median positive step between frequencies, and whether its axis is that of the transform."""
    step = F.lead("freq_hz").over(Window.partitionBy("note").orderBy("freq_hz")) - F.col("freq_hz")
    rows = spectrum.select("note", step.alias("step"))
    out = rows.groupBy("note").agg(F.percentile(F.when(F.col("step") > 0, F.col("step")), 0.5).alias("step_hz"), F.count("*").alias("points"))
    return out.select("note", "step_hz", resolution.regular_grid(F.col("step_hz"), sample_rate, n_fft, F.col("points")).alias("regular"))


def band_regions(notes: DataFrame, peaks: DataFrame, low_hz: float, high_hz: float, exclusion_hz: float) -> DataFrame:
    """How much of a band the peaks' footprints cover, and how much is left."""
    lo, hi = F.greatest(F.lit(low_hz), F.col("freq_hz") - exclusion_hz / 2), F.least(F.lit(high_hz), F.col("freq_hz") + exclusion_hz / 2)
    spans = peaks.select("note", lo.alias("lo"), hi.alias("hi")).filter("hi > lo")
    out = notes.join(covered_length(spans, ["note"], "lo", "hi"), "note", "left")
    covered = F.least(F.coalesce("covered", F.lit(0.0)), F.lit(high_hz - low_hz))
    return out.select("note", (F.lit(high_hz - low_hz) - covered).alias("residual_hz"), covered.alias("excluded_hz"))


def low_band_aggregates(components: DataFrame) -> DataFrame:
    """A note's low band as one row: root of its energy, its sum, mean frequency, energy of members; floor rows; mean ratio of validated harmonics by power."""
    low, good = F.col("comp") == "S", (F.col("comp") == "H") & F.col("include")
    p = F.col("amp") * F.col("amp")
    return components.groupBy("note").agg(
        F.sqrt(F.sum(F.when(low, p))).alias("amplitude"),
        F.sum(F.when(low, F.col("amp"))).alias("mass"),
        F.avg(F.when(low, F.col("freq_hz"))).alias("mean_hz"),
        F.coalesce(F.sum(F.when(F.col("member"), p)), F.lit(0.0)).alias("gated_energy"),
        F.count_if(F.col("status") == "floor").alias("floor_rows"),
        F.try_divide(F.sum(F.when(good & F.col("snr_db").isNotNull(), p * F.col("snr_db"))), F.sum(F.when(good & F.col("snr_db").isNotNull(), p))).alias("snr_db"),
    )


def high_order_guards(candidates: DataFrame, false_alarm: float, marginal: str, weak: str) -> DataFrame:
    """Accepted orders per note, those above its ``stop``, and whether there are more than the body and chance explain."""
    accepted = F.col("include")
    counts = candidates.groupBy("note").agg(
        F.count("*").alias("slots"),
        F.count_if(accepted).alias("accepted"),
        F.count_if(accepted & (F.col("n") > F.col("stop"))).alias("above"),
        F.count_if(F.col("status") == marginal).alias("marginal"),
        F.count_if(accepted & (F.col("status") == weak)).alias("weak"),
        F.max("stop").alias("stop"),
    )
    suspect = F.coalesce(F.col("accepted") > F.col("stop") + resolution.false_slots(F.col("slots"), false_alarm), F.lit(False))
    return counts.select("note", "accepted", "above", suspect.alias("suspect"), "marginal", "weak", (F.col("accepted") - F.col("weak")).alias("strict"))


def policy_report(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Per check: rows that break it (null counts as a breach), rows, and ok, degraded or failed."""
    wide = rows.agg(F.count("*").alias("_n"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    cells = F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(f"`{n}`").alias("violations"), F.col("_n").alias("rows_checked")) for n in checks])
    status = F.when(F.col("violations") == 0, "ok").when(F.col("violations") < F.col("rows_checked"), "degraded").otherwise("failed")
    return wide.select(F.explode(cells).alias("x")).select("x.*").withColumn("status", status)


def mixed_profiles(rows: DataFrame, keys: list[str], profile: str) -> DataFrame:
    """How many profiles each group has."""
    n = F.countDistinct(profile)
    return rows.groupBy(*keys).agg(n.alias("profiles"), (n > 1).alias("mixed"))


def rejections(rows: DataFrame, what: Column, order: list[str]) -> DataFrame:
    """Rejected rows of each note: how many, and what they are, in order."""
    item = F.struct(*[F.col(c) for c in order], what.alias("_what"))
    return rows.groupBy("note").agg(F.count("*").alias("rejected"), F.transform(F.sort_array(F.collect_list(item)), lambda x: x["_what"]).alias("what"))
