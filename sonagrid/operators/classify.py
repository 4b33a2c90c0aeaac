"""From peaks to compartments: gates, exclusive assignment to slots, stops and leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonagrid.functions import scales
from sonagrid.operators.ranges import outside_bands


def relative_level_gate(components: DataFrame, threshold_db: float = -20.0) -> DataFrame:
    """Rows at most so far below their note's loudest level; rows without a level pass."""
    top = F.max("db").over(Window.partitionBy("note"))
    rows = components.withColumn("_top", top)
    return rows.filter(F.col("db").isNull() | (F.col("db") >= F.col("_top") + threshold_db)).drop("_top")


def strength_gate(components: DataFrame, share: float = 0.01, ceiling_hz: float = 12000.0) -> DataFrame:
    """Amplitudes of at least a share of their note's largest, up to a frequency."""
    top = F.max("amp").over(Window.partitionBy("note"))
    return components.withColumn("_top", top).filter((F.col("amp") >= share * F.col("_top")) & (F.col("freq_hz") <= ceiling_hz)).drop("_top")


def standard_components(rows: DataFrame, ceiling_hz: float | None = None, included_only: bool = False) -> DataFrame:
    """Rows with a positive amplitude, up to a ceiling (rows without a frequency pass), validated ones only if asked."""
    keep = F.col("amp") > 0
    if ceiling_hz is not None:
        keep = keep & (F.col("freq_hz").isNull() | (F.col("freq_hz") <= ceiling_hz))
    if included_only:
        keep = keep & F.coalesce(F.col("include"), F.lit(False))
    return rows.filter(keep)


def validated() -> Column:
    """Whether a component counts: harmonic ones if included, others by status."""
    return F.when(F.col("comp") == "H", F.col("include")).otherwise(F.col("status").isin("confirmed"))


def balanced_pool(components: DataFrame) -> DataFrame:
    """Union of validated harmonic, confirmed residual and low-band components, without floor rows."""
    h = components.filter((F.col("comp") == "H") & F.col("include"))
    i = components.filter((F.col("comp") == "I") & (F.col("status") == "confirmed"))
    s = components.filter((F.col("comp") == "S") & (F.col("freq_hz") <= 2000.0))
    return h.unionByName(i).unionByName(s).filter(F.col("status") != "floor")


def harmonic_slots(components: DataFrame, bin_hz: float = 5.0, tolerance_cents: float = 30.0, spacing_cap: float = 0.30) -> DataFrame:
    """Each row's nearest order rint(f / f0), its deviation, tolerance and whether it lies within."""
    order = F.greatest(F.lit(1.0), F.rint(F.col("peak_hz") / F.col("f0_hz")))
    tol, limb = scales.harmonic_tolerance(F.col("slot"), F.col("f0_hz"), bin_hz, tolerance_cents, spacing_cap)
    rows = components.withColumn("slot", order)
    rows = rows.withColumn("deviation_hz", F.abs(F.col("peak_hz") - F.col("slot") * F.col("f0_hz"))).withColumn("tolerance_hz", tol).withColumn("limb", limb)
    return rows.withColumn("within", F.col("deviation_hz") <= F.col("tolerance_hz"))


def exclusive_assignment(slots: DataFrame) -> DataFrame:
    """One slot a peak bin (smallest deviation), then one peak a slot (loudest); says why a row lost."""
    inside = slots.filter("within")
    by_bin = Window.partitionBy("note", "bin").orderBy("deviation_hz", "slot", F.desc("amp"), "part")
    first = inside.withColumn("_bin", F.row_number().over(by_bin))
    by_slot = Window.partitionBy("note", "slot", F.col("_bin") == 1).orderBy(F.desc("amp"), "deviation_hz", "part", "bin")
    ranked = first.withColumn("_slot", F.row_number().over(by_slot))
    reason = F.when(F.col("_bin") > 1, "peak_bin_taken").when(F.col("_slot") > 1, "slot_taken").otherwise("assigned")
    out = ranked.withColumn("assignment", reason).drop("_bin", "_slot")
    return out.unionByName(slots.filter("not within").withColumn("assignment", F.lit("rejected_by_tolerance")))


def alignment(slots: DataFrame) -> DataFrame:
    """Per note: orders found, median, 95th percentile and energy-weighted cents error, energy within, and a status."""
    err = F.abs(scales.cents(F.col("peak_hz") / (F.col("slot") * F.col("f0_hz"))))
    e = F.col("amp") * F.col("amp")
    rows = slots.withColumn("err", err).withColumn("e", e)
    w = F.when(F.col("within"), F.col("e"))
    out = rows.groupBy("note").agg(
        F.countDistinct(F.when(F.col("within"), F.col("slot"))).alias("orders"),
        F.percentile(F.when(F.col("within"), F.col("err")), 0.5).alias("median_cents"),
        F.percentile(F.when(F.col("within"), F.col("err")), 0.95).alias("p95_cents"),
        F.try_divide(F.sum(w * F.col("err")), F.sum(w)).alias("weighted_cents"),
        F.try_divide(F.coalesce(F.sum(w), F.lit(0.0)), F.sum("e")).alias("energy_within"),
    )
    status = F.when(F.col("orders") == 0, "none").when((F.col("orders") >= 3) & (F.col("energy_within") >= 0.5), "good").when(F.col("energy_within") >= 0.25, "fair").otherwise("weak")
    return out.withColumn("status", status)


def continuity_override(slots: DataFrame, persistence: float = 0.05, factor: float = 2.0) -> DataFrame:
    """A rejected order between two accepted neighbours comes back if it persists and lies within factor x tolerance."""
    best = slots.groupBy("note", "slot").agg(F.bool_or("within").alias("within"), F.max("persistence").alias("persistence"), F.min(F.try_divide("deviation_hz", "tolerance_hz")).alias("excess"))
    order = Window.partitionBy("note").orderBy("slot")
    rows = best.withColumn("_below", (F.lag("slot").over(order) == F.col("slot") - 1) & F.lag("within").over(order)).withColumn("_above", (F.lead("slot").over(order) == F.col("slot") + 1) & F.lead("within").over(order))
    back = ~F.col("within") & F.coalesce(F.col("_below") & F.col("_above"), F.lit(False)) & (F.col("persistence") >= persistence) & (F.col("excess") <= factor)
    return rows.withColumn("restored", back).select("note", "slot", "within", "restored", (F.col("within") | F.col("restored")).alias("accepted"))


def body_stop(components: DataFrame, margin_db: float = 3.0, consecutive: int = 2, floor_quantile: float = 0.15) -> DataFrame:
    """The first order from which ``consecutive`` orders' envelope is within margin of the note's floor; null if none.

    envelope: median level of the last five orders; floor: a low quantile of the note's levels.
    """
    levels = components.groupBy("note", "n").agg(F.max("db").alias("db"))
    order = Window.partitionBy("note").orderBy("n")
    floor = F.percentile("db", floor_quantile).over(Window.partitionBy("note"))
    rows = levels.withColumn("envelope", F.percentile("db", 0.5).over(order.rowsBetween(-4, 0))).withColumn("floor", floor)
    low = (F.col("envelope") <= F.col("floor") + margin_db).cast("int")
    rows = rows.withColumn("low", low).withColumn("run", F.sum("low").over(order.rowsBetween(-(consecutive - 1), 0))).withColumn("first", F.lag("n", consecutive - 1).over(order))
    return rows.groupBy("note").agg(F.min(F.when(F.col("run") == consecutive, F.col("first"))).alias("stop_order"), F.count("*").alias("orders"))


def rejection_latch(components: DataFrame, streak: int = 2) -> DataFrame:
    """Orders after the first run of ``streak`` rejected orders are dropped: kept orders per note."""
    by = components.groupBy("note", "n").agg(F.bool_or("include").alias("ok"))
    order = Window.partitionBy("note").orderBy("n")
    run = F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(order.rowsBetween(-(streak - 1), 0))
    full = F.count("*").over(order.rowsBetween(-(streak - 1), 0)) == streak
    stop = F.min(F.when(full & (F.col("run") == streak), F.col("n"))).over(Window.partitionBy("note"))
    rows = by.withColumn("run", run).withColumn("stop", stop)
    return rows.filter(F.col("stop").isNull() | (F.col("n") <= F.col("stop"))).groupBy("note").agg(F.count_if("ok").alias("kept"), F.max("stop").alias("stop"))


def residual_rows(components: DataFrame, half_width_hz: float = 150.0) -> DataFrame:
    """Residual components that no validated harmonic of their note covers."""
    centres = components.filter((F.col("comp") == "H") & F.col("include")).select("note", F.col("freq_hz").alias("centre"))
    return outside_bands(components.filter(F.col("comp") == "I"), centres, ["note"], "freq_hz", "centre", half_width_hz)


def candidate_status(snr_db: Column, prominence_db: Column, local_peak: Column) -> Column:
    """Ordered states of a harmonic candidate; only strict_validated is included."""
    return F.when(~local_peak, "not_local_peak").when((snr_db >= 12) & (prominence_db >= 6), "strict_validated").when(snr_db >= 12, "snr_validated").when(snr_db >= 3, "weak").otherwise("rejected_low_snr")


def margin_gate(margin_db: Column, persistence: Column, least_db: float = 3.0, strong: float = 0.9) -> Column:
    """rejected below 0 dB, validated from least_db on; between, persistent rows stay as validated_weak."""
    return F.when(margin_db.isNull() | (margin_db <= 0), "rejected").when(margin_db >= least_db, "validated").when(persistence >= strong, "validated_weak").otherwise("marginal")


def confirm_residual(cfar_ok: Column, comb_member: Column, leaked: Column, local_peak: Column, persistence: Column, least: float = 0.5) -> Column:
    """Ordered confirmation of a residual candidate; a missing persistence passes."""
    return F.when(~cfar_ok, "floor").when(comb_member, "stretched_comb_member").when(leaked, "leakage").when(~local_peak | (persistence < least), "not_confirmed").otherwise("confirmed")


def duplicate_bins(components: DataFrame) -> DataFrame:
    """Peak bins that more than one included row of a note claims."""
    return components.filter("include").groupBy("note", "bin").agg(F.count("*").alias("claims")).filter("claims > 1")


def refit_fundamental(slots: DataFrame, highest: int = 8) -> DataFrame:
    """Weighted least squares of f = n f0 over low orders: f0, and how far in cents from the old one."""
    rows = slots.filter(F.col("within") & (F.col("slot") <= highest)).withColumn("w", F.col("amp"))
    fit = F.try_divide(F.sum(F.col("w") * F.col("slot") * F.col("peak_hz")), F.sum(F.col("w") * F.col("slot") * F.col("slot")))
    out = rows.groupBy("note").agg(fit.alias("f0_refit"), F.max("f0_hz").alias("f0_hz"))
    return out.withColumn("discrepancy_cents", scales.cents(F.col("f0_refit") / F.col("f0_hz"))).withColumn("applied", F.abs("discrepancy_cents") > 15)


def stretch_fit(slots: DataFrame) -> DataFrame:
    """Joint least squares of (f / n)^2 = f0^2 + f0^2 B n^2 by moment sums: f0 and B, null with fewer than three orders."""
    x, y = F.col("slot") * F.col("slot"), F.pow(F.col("peak_hz") / F.col("slot"), F.lit(2.0))
    rows = slots.filter("within").select("note", x.alias("x"), y.alias("y"))
    out = rows.groupBy("note").agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.countDistinct("x").alias("orders"))
    good = (F.col("orders") >= 3) & (F.col("intercept") > 0)
    return out.select("note", F.when(good, F.sqrt("intercept")).alias("f0_fit"), F.when(good, F.col("slope") / F.col("intercept")).alias("b"), "orders")
