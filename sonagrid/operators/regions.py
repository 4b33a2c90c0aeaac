"""A note's peaks in three disjoint regions, and the densities, energies and weights that follow.

Input: note, f0_hz, freq_hz, power, one row a peak. :func:`regions` needs one shuffle, by note, and
sorts by frequency once (again by power only where ``loudest`` is read); :func:`descriptors`
aggregates twice on that same partitioning. A peak below the low band's bound
is low (S), one within an order's tolerance is harmonic (H), the rest is residual (I).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonagrid.functions.resolution import expected_log_bins, expected_orders
from sonagrid.functions.scales import low_band_upper


class Bounds(NamedTuple):
    low_hz: float = 20.0
    high_hz: float = 20000.0
    body_hz: float = 5000.0
    ceiling_hz: float = 12000.0
    relative_db: float = -80.0  # peaks further below the note's loudest don't count
    salience_db: float = -60.0
    tolerance_cents: float = 30.0
    spacing_cap: float = 0.30
    bin_cents: float = 25.0
    knee_hz: float = 1500.0
    occupancy_weight: float = 0.25


def _clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def regions(peaks: DataFrame, b: Bounds = Bounds()) -> DataFrame:
    """Significant peaks with order, region, whether they are their order's loudest, salience and log bin."""
    note = Window.partitionBy("note")
    by_freq = note.orderBy("freq_hz", "power")
    rows = peaks.filter(F.col("freq_hz").between(b.low_hz, b.high_hz) & (F.col("power") >= 0) & (F.col("f0_hz") > 0))
    whole = by_freq.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in the order of what follows: one sort
    rows = rows.withColumn("top", F.max("power").over(whole)).filter((F.col("top") > 0) & (F.col("power") >= F.col("top") * 10 ** (b.relative_db / 10)))
    rows = rows.withColumn("step", F.lead("freq_hz").over(by_freq) - F.col("freq_hz"))
    rows = rows.withColumn("step_hz", F.coalesce(F.percentile(F.when(F.col("step") > 1e-12, F.col("step")), 0.5).over(note), F.col("f0_hz") / 8))
    rows = rows.withColumn("order", F.rint(F.col("freq_hz") / F.col("f0_hz")))
    slot = F.col("order") * F.col("f0_hz")
    rows = rows.withColumn("tolerance_hz", F.greatest(F.col("step_hz"), F.least(F.greatest(slot * b.tolerance_cents / 1200, F.col("step_hz")), b.spacing_cap * F.col("f0_hz"))))
    near = F.coalesce((F.col("order") >= 1) & (F.abs(1200 * F.log2(F.col("freq_hz") / slot)) <= 1200 * F.col("tolerance_hz") / slot), F.lit(False))
    low = F.col("freq_hz") < F.greatest(F.lit(b.low_hz), low_band_upper(F.col("f0_hz")))
    rows = rows.withColumn("region", F.when(low, "S").when(near, "H").otherwise("I"))
    rank = F.row_number().over(Window.partitionBy("note", "region", "order").orderBy(F.desc("power"), "freq_hz"))
    salience = _clip01((10 * F.log10(F.greatest(F.col("power"), F.lit(1e-300)) / F.col("top")) - b.salience_db) / -b.salience_db)
    before, after = F.lag("power").over(by_freq), F.lead("power").over(by_freq)
    n = F.count("*").over(note)
    peak = F.when(n == 1, True).otherwise(F.coalesce((F.col("power") > before) & (F.col("power") >= after), F.lit(False)))
    log_bin = F.floor(1200 * F.log2(F.col("freq_hz") / b.low_hz) / b.bin_cents)
    return rows.withColumns({"loudest": (F.col("region") == "H") & (rank == 1), "salience": salience, "peak": peak, "log_bin": log_bin}).drop("step")


def _effective(c: Column) -> Column:
    return F.coalesce(F.try_divide(F.pow(F.sum(c), F.lit(2.0)), F.sum(c * c)), F.lit(0.0))


def descriptors(peaks: DataFrame, b: Bounds = Bounds()) -> DataFrame:
    """One row a note: energies and shares, occupancy, densities, strengths, observed weights and weighted totals."""
    rows = regions(peaks, b)
    region, p, f = F.col("region"), F.col("power"), F.col("freq_hz")
    slot = F.col("order") * F.col("f0_hz")
    counted = F.when(region == "H", slot <= b.ceiling_hz).when(region == "I", f <= b.ceiling_hz).otherwise(F.col("peak") & (f <= b.ceiling_hz))
    unit = F.when(region == "H", F.col("order")).when(region == "I", F.col("log_bin")).otherwise(f)
    # First by order, log bin or peak, then by note: both on the partitioning by note.
    # An order's energy is its loudest peak's; of equally loud ones the lowest tells whether it lies in the body.
    body = F.when(f <= b.body_hz, p)
    weighted = F.when(f.between(b.low_hz, b.body_hz), F.sqrt(p) / (1 + (f / b.knee_hz) * (f / b.knee_hz)))
    units = rows.withColumn("unit", unit).groupBy("note", "region", "unit").agg(
        F.max("f0_hz").alias("f0_hz"),
        F.max("step_hz").alias("step_hz"),
        F.max(F.when(counted, F.col("salience"))).alias("salience"),
        F.when(region == "H", F.max(p)).otherwise(F.sum(p)).alias("e"),
        F.when(region != "H", F.sum(body)).when(F.max(body) == F.max(p), F.max(p)).otherwise(0.0).alias("e_body"),
        F.sum(F.when(counted & (region == "S"), p)).alias("e_low_peaks"),
        F.sum(p).alias("p"),
        F.sum(p * p).alias("pp"),
        F.sum(weighted).alias("w"),
        F.sum(weighted * weighted).alias("ww"),
    )

    def of(r: str, c: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("region") == r, F.col(c))), F.lit(0.0))

    lower = lambda c: c.lower()
    counts = {f"count_{lower(r)}": F.count_if((F.col("region") == r) & (F.col("salience") > 0)).alias(f"count_{lower(r)}") for r in "HIS"}
    out = units.groupBy("note").agg(
        F.max("f0_hz").alias("f0_hz"),
        F.max("step_hz").alias("step_hz"),
        *[of(r, "e").alias(f"e_{lower(r)}") for r in "HIS"],
        *[of(r, "e_body").alias(f"body_{lower(r)}") for r in "HI"],
        of("S", "e_low_peaks").alias("body_s"),
        *[of(r, "salience").alias(f"density_{lower(r)}") for r in "HIS"],
        *counts.values(),
        *[F.coalesce(F.try_divide(F.pow(of(r, "p"), F.lit(2.0)), of(r, "pp")), F.lit(0.0)).alias(f"effective_{lower(r)}") for r in "HIS"],
        F.count_if(F.col("region") == "H").alias("orders_found"),
        F.coalesce(F.try_divide(F.pow(F.sum("w"), F.lit(2.0)), F.sum("ww")), F.lit(0.0)).alias("body_effective"),
    )
    total = F.col("e_h") + F.col("e_i") + F.col("e_s")
    out = out.withColumns({f"share_{c}": F.try_divide(F.col(f"e_{c}"), total) for c in "his"})
    upper = low_band_upper(F.col("f0_hz"))
    out = out.withColumns(
        {
            "expected_h": F.floor(b.ceiling_hz / F.col("f0_hz")),
            "expected_i": expected_log_bins(F.greatest(F.lit(b.low_hz), upper), b.ceiling_hz, b.bin_cents),
            "expected_s": F.ceil(F.greatest(F.lit(0.0), upper - b.low_hz) / F.greatest(F.lit(1.0), F.col("step_hz"))),
            "occupancy": F.coalesce(F.least(F.lit(1.0), F.try_divide(F.col("orders_found").cast("double"), expected_orders(F.col("f0_hz"), b.low_hz, b.high_hz))), F.lit(0.0)),
        }
    )
    # Strength by register: what is there as a share of what could be; nothing where nothing could be.
    for c in "his":
        could = F.col(f"expected_{c}")
        own = _clip01(F.col(f"density_{c}") / could) + b.occupancy_weight * _clip01(F.col(f"count_{c}") / could)
        out = out.withColumn(f"strength_{c}", F.when(could > 0, own).otherwise(0.0))
    zero = F.concat_ws("|", *[F.when(F.col(f"expected_{c}") <= 0, c) for c in "his"])
    gate = {c: F.coalesce(F.col(f"share_{c}"), F.lit(1 / 3)) for c in "his"}
    out = out.withColumns({f"gated_{c}": F.col(f"strength_{c}") * gate[c] for c in "his"}).withColumn("no_slots", zero)
    gated = F.col("gated_h") + F.col("gated_i") + F.col("gated_s")
    default = {"h": 4 / 7, "i": 2 / 7, "s": 1 / 7}
    out = out.withColumns({f"weight_{c}": F.when(gated > 1e-12, F.col(f"gated_{c}") / gated).otherwise(default[c]) for c in "his"})

    def weighted_sum(names: dict[str, str]) -> Column:
        return F.col("weight_h") * F.col(names["h"]) + F.col("weight_i") * F.col(names["i"]) + F.col("weight_s") * F.col(names["s"])

    out = out.withColumns(
        {
            "total_body": weighted_sum({"h": "body_h", "i": "body_i", "s": "body_s"}),
            "total_full": weighted_sum({"h": "e_h", "i": "e_i", "s": "body_s"}),
            "density_count": weighted_sum({c: f"count_{c}" for c in "his"}),
            "density_salience": weighted_sum({c: f"density_{c}" for c in "his"}),
            "effective_weighted": F.coalesce(sum((F.col(f"effective_{c}") * F.col(f"share_{c}") for c in "is"), F.col("effective_h") * F.col("share_h")), F.lit(0.0)),
            "upper_activity": F.coalesce(F.try_divide(F.col("e_h") - F.col("body_h") + F.col("e_i") - F.col("body_i"), F.col("e_h") + F.col("e_i")), F.lit(0.0)),
        }
    )
    return out.withColumn("extension_index", F.col("total_full") / F.greatest(F.col("total_body"), F.lit(1e-12)))


def pooled_fatness(peaks: DataFrame) -> DataFrame:
    """(sum A^2)^2 / sum A^4: of harmonic components, and of all."""
    p = F.col("amp") * F.col("amp")
    return peaks.groupBy("note").agg(_effective(F.when(F.col("comp") == "H", p)).alias("fatness_h"), _effective(p).alias("fatness"))


def spectral_complexity(spectrum: DataFrame, share: float = 0.05, tolerance: float = 0.03) -> DataFrame:
    """0.4 irregularity against a moving mean, 0.4 of the energy that lies off the harmonics, 0.2 entropy, between 0 and 1.

    Input: note, f0_hz, freq_hz, amp. The mean runs over a ``share`` of the note's bins (3 at
    least); beyond the ends there are zeros.
    """
    note = Window.partitionBy("note")
    at = F.row_number().over(note.orderBy("freq_hz"))
    n = F.count("*").over(note)
    width = F.greatest(F.lit(3), F.floor(n * share).cast("int"))
    rows = spectrum.withColumn("n", n).withColumn("width", width).withColumn("at", at)
    upto = F.sum("amp").over(note.orderBy("freq_hz").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto)
    # A moving sum is a difference of running sums; those at both ends are looked up by their place.
    rows = rows.withColumn("last", F.least(F.col("n"), F.col("at") + F.floor((F.col("width") - 1) / 2))).withColumn("first", F.col("at") - F.floor(F.col("width") / 2) - 1)
    for end in ("last", "first"):
        rows = rows.join(rows.select("note", F.col("at").cast("long").alias(end), F.col("upto").alias(f"upto_{end}")), ["note", end], "left")
    mean = (F.col("upto_last") - F.coalesce("upto_first", F.lit(0.0))) / F.col("width")
    order = F.greatest(F.lit(1.0), F.rint(F.col("freq_hz") / F.col("f0_hz")))
    near = F.abs(F.col("freq_hz") - order * F.col("f0_hz")) <= tolerance * order * F.col("f0_hz")
    e = F.col("amp") * F.col("amp")
    q = e / F.sum(e).over(note)
    rows = rows.select("note", "amp", e.alias("e"), F.abs(F.col("amp") - mean).alias("off"), near.alias("near"), F.when(q > 1e-10, q).alias("q"), (F.col("n") > F.col("width")).alias("long"))
    out = rows.groupBy("note").agg(
        F.when(F.max("long"), F.try_divide(F.avg("off"), F.avg("amp"))).otherwise(0.0).alias("irregularity"),
        (1 - F.try_divide(F.sum(F.when(F.col("near"), F.col("e")).otherwise(0.0)), F.sum("e"))).alias("off_harmonic"),
        F.try_divide(-F.sum(F.col("q") * F.log("q")), F.log(F.count("q").cast("double"))).alias("entropy"),
    )
    total = 0.4 * F.coalesce("irregularity", F.lit(0.0)) + 0.4 * F.coalesce("off_harmonic", F.lit(0.0)) + 0.2 * F.coalesce("entropy", F.lit(0.0))
    return out.withColumn("complexity", _clip01(total))
