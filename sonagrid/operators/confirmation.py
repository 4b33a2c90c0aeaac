"""Whether a residual peak is one of its own: detection, the stretched comb, leakage, local shape, persistence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonagrid.functions.resolution import leakage_half_width
from sonagrid.functions.scales import harmonic_tolerance, stretched
from sonagrid.operators.classify import confirm_residual
from sonagrid.operators.persistence import cfar, prominence
from sonagrid.operators.ranges import outside_bands


def comb_order(freq: Column, f0: Column, b: Column) -> Column:
    """The order whose stretched partial is nearest: n from f^2 = n^2 f0^2 (1 + B n^2), rounded, 1 at least."""
    ratio = freq * freq / (f0 * f0)
    square = F.when(b > 1e-12, (F.sqrt(1 + 4 * b * ratio) - 1) / (2 * b)).otherwise(ratio)
    return F.greatest(F.lit(1.0), F.rint(F.sqrt(square)))


def residual_confirmation(candidates: DataFrame, spectrum: DataFrame, accepted: DataFrame, bin_hz: float, lobe_bins: float = 4.0, train: int = 64, false_alarms: float = 1e-2, least_prominence_db: float = 3.0, least_persistence: float = 0.5, least_stretch: float = 1e-6) -> DataFrame:
    """candidates (note, bin, freq_hz, f0_hz, b, persistence) with the predicates and the ordered status.

    spectrum: note, bin, amp; accepted: note and ``centre``, the frequency of an accepted harmonic.
    The comb counts only where stretch was found (b over ``least_stretch``). Each predicate is an
    equality join on (note, bin), or a leakage band on cells.
    """
    noise = cfar(spectrum, false_alarms=false_alarms, train=train).select("note", "bin", "margin_db", "detected")
    shape = prominence(spectrum)
    half = lobe_bins * bin_hz / 2
    clear = outside_bands(candidates, accepted, ["note"], "freq_hz", "centre", half).select("note", "bin", F.lit(False).alias("leaked"))
    order = comb_order(F.col("freq_hz"), F.col("f0_hz"), F.col("b"))
    tolerance, _ = harmonic_tolerance(F.col("order"), F.col("f0_hz"), bin_hz)
    rows = candidates.join(noise, ["note", "bin"], "left").join(shape, ["note", "bin"], "left").join(clear, ["note", "bin"], "left").withColumn("order", order)
    comb = F.coalesce((F.col("b") > least_stretch) & (F.abs(F.col("freq_hz") - stretched(F.col("order"), F.col("f0_hz"), F.col("b"))) <= tolerance), F.lit(False))
    rows = rows.withColumns({"detected": F.coalesce("detected", F.lit(False)), "leaked": F.coalesce("leaked", F.lit(True)), "comb": comb, "local": F.coalesce(F.col("prominence_db") >= least_prominence_db, F.lit(False))})
    status = confirm_residual(F.col("detected"), F.col("comb"), F.col("leaked"), F.col("local"), F.coalesce("persistence", F.lit(1.0)), least_persistence)
    return rows.withColumn("status", status)


def reassigned(confirmed: DataFrame) -> DataFrame:
    """Rows that the comb explains as harmonics of their order."""
    return confirmed.filter(F.col("status") == "stretched_comb_member").select("note", F.lit("H").alias("comp"), F.col("order").cast("long").alias("n"), "freq_hz")


def rematched_stretch(peaks: DataFrame, rounds: int = 4, cents: float = 50.0, least: int = 3, least_t: float = 2.0) -> DataFrame:
    """f0 and B per note by joint least squares of f^2 = a n^2 + a B n^4, matching orders anew in every round.

    Input: note, f0_hz, freq_hz. Peaks within ``cents`` of their nearest stretched order take part,
    of orders up to 8 in the first round and twice as many in each further one: before the stretch is
    known, high partials lie nearer to a wrong order. The last round takes all.
    B stays 0 with fewer than ``least`` orders, a slope that is not positive, or a t value under
    ``least_t`` (by more than the rounding of its sums). Each round is one aggregation by note and a join back on that partitioning.
    """
    state = peaks.groupBy("note").agg(F.max("f0_hz").alias("f0"), F.lit(0.0).alias("b"))
    for i in range(rounds):
        cap = F.lit(True) if i == rounds - 1 else F.col("k") <= 8 * 2**i
        met = peaks.join(state, "note")
        n = comb_order(F.col("freq_hz"), F.col("f0"), F.col("b"))
        met = met.withColumn("k", n)
        near = F.abs(1200 * F.log2(F.col("freq_hz") / stretched(F.col("k"), F.col("f0"), F.col("b")))) <= cents
        near = near & cap
        x, y = F.col("k") * F.col("k"), F.pow(F.col("freq_hz") / F.col("k"), F.lit(2.0))
        cells = met.select("note", F.col("f0_hz"), F.when(near, x).alias("x"), F.when(near, y).alias("y"))
        sums = cells.groupBy("note").agg(
            F.max("f0_hz").alias("start"),
            F.regr_slope("y", "x").alias("slope"),
            F.regr_intercept("y", "x").alias("intercept"),
            F.regr_sxx("y", "x").alias("sxx"),
            F.regr_syy("y", "x").alias("syy"),
            F.regr_sxy("y", "x").alias("sxy"),
            F.count("x").cast("double").alias("n"),
            F.countDistinct("x").alias("orders"),
        )
        left = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0)) / F.greatest(F.col("n") - 2, F.lit(1.0))
        t = F.col("slope") * F.sqrt(F.col("sxx")) / F.sqrt(F.greatest(left, F.lit(1e-18)))
        good = F.coalesce((F.col("orders") >= least) & (F.col("intercept") > 0) & (F.col("slope") > 0) & (t >= least_t - 1e-9), F.lit(False))
        state = sums.select("note", F.when(good, F.sqrt("intercept")).otherwise(F.col("start")).alias("f0"), F.when(good, F.col("slope") / F.col("intercept")).otherwise(0.0).alias("b"), "orders", good.alias("fitted"))
        if i < rounds - 1:
            state = state.select("note", "f0", "b")
    return state


def leakage_hz(sample_rate: float, n_fft: int, lobe_bins: float = 4.0) -> Column:
    return leakage_half_width(F.lit(sample_rate / n_fft), lobe_bins)
