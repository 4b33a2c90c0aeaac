"""Weighted density of grouped component tables.

Inputs have the columns note, comp (H, I or S), amp and where stated freq_hz. Every operator is one
or two levels of partial aggregation by note, so it shuffles sums, not components.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonagrid.functions import phi as weights
from sonagrid.functions.scales import erb_rate

COMPARTMENTS = ("H", "I", "S")
BALANCE = 0.5


def compartment_scores(components: DataFrame, name: str = "log", balance: float = BALANCE) -> DataFrame:
    """One row a note and compartment: its weighted sum, energy share, concentration penalty and scores.

    With s = phi(A): D = sum s, r = E / (E of the note), penalty = N_eff / N over positive s.
    strict = r D penalty, balanced = r D penalty^alpha.
    """
    s = weights.phi(name, F.col("amp"))
    rows = components.filter(F.col("amp") >= 0).withColumn("s", s)
    sums = rows.groupBy("note", "comp").agg(
        F.count(F.when(F.col("s") > 0, 1)).alias("count"),
        F.sum("s").alias("mass"),
        weights.participation(F.col("s")).alias("n_eff"),
        F.sum(F.col("amp") * F.col("amp")).alias("energy"),
    )
    total = F.sum("energy").over(Window.partitionBy("note"))
    penalty = F.coalesce(F.try_divide("n_eff", "count"), F.lit(0.0))
    share = F.coalesce(F.try_divide(F.col("energy"), total), F.lit(0.0))
    out = sums.withColumn("share", share).withColumn("penalty", penalty)
    weighted = F.col("share") * F.col("mass")
    return out.withColumn("strict", weighted * F.col("penalty")).withColumn("balanced", weighted * F.pow("penalty", F.lit(balance)))


def note_scores(components: DataFrame, name: str = "log", balance: float = BALANCE) -> DataFrame:
    """Strict and balanced density of every note."""
    return compartment_scores(components, name, balance).groupBy("note").agg(F.sum("strict").alias("strict"), F.sum("balanced").alias("balanced"))


def merge_scores(parts: DataFrame, balance: float = BALANCE) -> DataFrame:
    """Note scores again from compartment rows (share, mass, penalty) that were stored."""
    weighted = F.col("share") * F.col("mass")
    return parts.groupBy("note").agg(F.sum(weighted * F.col("penalty")).alias("strict"), F.sum(weighted * F.pow("penalty", F.lit(balance))).alias("balanced"))


def discrete_bundle(components: DataFrame) -> DataFrame:
    """D3, D10, D17 and D24 of every note's pooled components; D24 takes A of at least 1 % of the largest, up to 12 kHz."""
    top = F.max("amp").over(Window.partitionBy("note"))
    rows = components.withColumn("loud", (F.col("amp") >= 0.01 * top) & (F.col("freq_hz") <= 12000))
    return rows.groupBy("note").agg(*[weights.discrete(d, F.col("amp"), F.col("loud")).alias(d) for d in weights.DISCRETE])


def band_sums(components: DataFrame, name: str) -> DataFrame:
    """h, i, s and total per note: phi of each band's amplitude sum, 0 for a band without components."""
    sums = components.groupBy("note").agg(*[F.coalesce(F.sum(F.when(F.col("comp") == c, F.col("amp"))), F.lit(0.0)).alias(c.lower()) for c in COMPARTMENTS])
    out = sums.select("note", *[weights.phi(name, F.col(c.lower())).alias(c.lower()) for c in COMPARTMENTS])
    return out.withColumn("total", F.col("h") + F.col("i") + F.col("s"))


def energy_shares(components: DataFrame) -> DataFrame:
    """Share of each compartment in a note's energy; null where a note has none."""
    e = [F.coalesce(F.sum(F.when(F.col("comp") == c, F.col("amp") * F.col("amp"))), F.lit(0.0)) for c in COMPARTMENTS]
    sums = components.groupBy("note").agg(*[x.alias(f"e_{c.lower()}") for c, x in zip(COMPARTMENTS, e, strict=True)])
    total = F.col("e_h") + F.col("e_i") + F.col("e_s")
    return sums.select("note", *[F.when(total > 0, F.col(f"e_{c}") / total).alias(f"r_{c}") for c in "his"])


def weighted_density(components: DataFrame, name: str = "log") -> DataFrame:
    """Sum over compartments of energy share times sum of phi."""
    s = weights.phi(name, F.col("amp"))
    sums = components.groupBy("note", "comp").agg(F.sum(s).alias("d"), F.sum(F.col("amp") * F.col("amp")).alias("e"))
    return sums.groupBy("note").agg(F.try_divide(F.sum(F.col("d") * F.col("e")), F.sum("e")).alias("density"))


def effective_counts(components: DataFrame) -> DataFrame:
    """Effective number of components: harmonic only, validated harmonic only, and pooled."""
    p = F.col("amp") * F.col("amp")
    h = F.col("comp") == "H"
    return components.groupBy("note").agg(
        weights.participation(F.when(h, p)).alias("harmonic"),
        weights.participation(F.when(h & F.col("include"), p)).alias("validated"),
        weights.participation(p).alias("pooled"),
    )


def rolloff_compensated(components: DataFrame, name: str = "log", alpha: float = 1.5, epsilon: float = 1e-12) -> DataFrame:
    """Sum of phi((A / max A) / (n^-alpha + epsilon)) per note, and the same a component."""
    top = F.max("amp").over(Window.partitionBy("note"))
    level = F.try_divide(F.col("amp"), top) / (F.pow(F.col("n").cast("double"), F.lit(-alpha)) + epsilon)
    return components.withColumn("x", weights.phi(name, level)).groupBy("note").agg(F.sum("x").alias("compensated"), F.avg("x").alias("per_component"))


def effective_power_density(components: DataFrame) -> DataFrame:
    """Sum of P / max P over harmonic components, per note and a component."""
    p = F.col("amp") * F.col("amp")
    h = components.filter(F.col("comp") == "H")
    return h.groupBy("note").agg(F.try_divide(F.sum(p), F.max(p)).alias("density"), F.try_divide(F.sum(p), F.max(p) * F.count("*")).alias("per_component"), F.sum(p).alias("mass"))


def harmonic_occupancy(components: DataFrame, f_max: float = 4000.0) -> DataFrame:
    """Distinct validated orders rint(f / f0) as a share of floor(f_max / f0), 1 at most."""
    order = F.rint(F.col("peak_hz") / F.col("f0_hz"))
    slots = F.floor(F.lit(f_max) / F.col("f0_hz"))
    rows = components.filter((F.col("comp") == "H") & F.col("include")).withColumn("order", order).withColumn("slots", slots)
    return rows.groupBy("note").agg(F.least(F.lit(1.0), F.countDistinct("order") / F.max("slots")).alias("occupancy"), F.max("slots").cast("long").alias("slots"))


def log_frequency_occupancy(components: DataFrame, f_min: float = 100.0, f_max: float = 5000.0, per_octave: int = 24) -> DataFrame:
    """Distinct log-frequency bins of residual components as a share of all bins of the range."""
    bins = F.ceil(F.lit(per_octave) * F.log2(F.lit(f_max / f_min)))
    at = F.greatest(F.lit(0), F.least(bins - 1, F.floor(per_octave * F.log2(F.col("freq_hz") / f_min))))
    rows = components.filter((F.col("comp") == "I") & F.col("freq_hz").between(f_min, f_max))
    return rows.groupBy("note").agg((F.countDistinct(at) / bins).alias("occupancy"))


def pooled_components(components: DataFrame, relative_db: float = -40.0) -> DataFrame:
    """Effective number of powers where harmonics under the gate and all residual components are pooled into one item each."""
    p = F.col("amp") * F.col("amp")
    top = F.max(F.when(F.col("comp") == "H", p)).over(Window.partitionBy("note"))
    strong = (F.col("comp") == "H") & (p >= top * 10 ** (relative_db / 10))
    rows = components.withColumn("p", p).withColumn("kind", F.when(strong, "strong").when(F.col("comp") == "H", "weak").otherwise("rest"))
    sums = rows.groupBy("note", "kind").agg(F.sum("p").alias("p"), F.sum(F.col("p") * F.col("p")).alias("pp"))
    squares = F.when(F.col("kind") == "strong", F.col("pp")).otherwise(F.col("p") * F.col("p"))
    return sums.groupBy("note").agg(F.try_divide(F.sum("p") ** 2, F.sum(squares)).alias("effective"))


def band_occupancy(spectrum: DataFrame, width_hz: float = 500.0, least: float = 0.5) -> DataFrame:
    """Bands of a fixed width whose amplitude sum exceeds ``least``, and their share of all bands seen."""
    bands = spectrum.groupBy("note", F.floor(F.col("freq_hz") / width_hz).alias("band")).agg(F.sum("amp").alias("a"))
    return bands.groupBy("note").agg(F.count_if(F.col("a") > least).alias("occupied"), F.avg((F.col("a") > least).cast("double")).alias("share"))


def salience(components: DataFrame, threshold_db: float = -60.0) -> DataFrame:
    """Per note: sum and count of clip((dB below the loudest - threshold) / -threshold, 0, 1) over orders, by their loudest component."""
    tops = components.filter(F.col("comp") == "H").groupBy("note", "n").agg(F.max(F.col("amp") * F.col("amp")).alias("p"))
    level = 10 * F.log10(F.col("p") / F.max("p").over(Window.partitionBy("note")))
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (level - threshold_db) / -threshold_db))
    return tops.withColumn("x", x).groupBy("note").agg(F.sum("x").alias("salience"), F.count_if(F.col("x") > 0).alias("salient"))


def odd_even_ratio(components: DataFrame) -> DataFrame:
    """Power of odd orders over that of even ones, harmonic components only; null without even ones."""
    p = F.col("amp") * F.col("amp")
    odd = F.sum(F.when(F.col("n") % 2 == 1, p))
    even = F.sum(F.when(F.col("n") % 2 == 0, p))
    return components.filter(F.col("comp") == "H").groupBy("note").agg(F.try_divide(F.coalesce(odd, F.lit(0.0)), even).alias("odd_even"))


def body_weighted(components: DataFrame, knee_hz: float = 1500.0, threshold_db: float = -50.0, low_hz: float = 1000.0) -> DataFrame:
    """Effective density of amplitudes / (1 + (f / knee)^2) near the loudest, and the low part's share of amplitude."""
    body = F.col("amp") / (1 + (F.col("freq_hz") / knee_hz) * (F.col("freq_hz") / knee_hz))
    rows = components.withColumn("b", body).withColumn("top", F.max(body).over(Window.partitionBy("note")))
    near = F.when(F.col("b") >= F.col("top") * 10 ** (threshold_db / 20), F.col("b"))
    low = F.sum(F.when(F.col("freq_hz") < low_hz, F.col("amp")).otherwise(0.0))
    return rows.groupBy("note").agg(weights.participation(near).alias("body_density"), F.try_divide(low, F.sum("amp")).alias("low_share"))


# Hill numbers and component density -----------------------------------------------------------


def hill(share: Column, q: float) -> Column:
    """Aggregate: the Hill number of order q of shares that sum to 1 (null for no shares)."""
    positive = F.when(share > 0, share)
    if q == 0:
        return F.count(positive).cast("double")
    if q == 1:
        return F.exp(-F.sum(positive * F.log(positive)))
    if q == float("inf"):
        return F.try_divide(F.lit(1.0), F.max(positive))
    return F.pow(F.sum(F.pow(positive, F.lit(q))), F.lit(1 / (1 - q)))


def hill_profile(components: DataFrame, keys: tuple[str, ...] = ("note",)) -> DataFrame:
    """D0, D1, D2, D-infinity of energy shares per group, and evenness D2 / D0."""
    p = F.col("amp") * F.col("amp")
    share = F.try_divide(p, F.sum(p).over(Window.partitionBy(*keys)))
    out = components.withColumn("p", share).groupBy(*keys).agg(*[hill(F.col("p"), q).alias(n) for q, n in ((0, "d0"), (1, "d1"), (2, "d2"), (float("inf"), "dinf"))])
    return out.withColumn("evenness", F.try_divide("d2", "d0"))


def hill_sweep(components: DataFrame, orders: tuple[float, ...] = (0, 0.5, 1, 1.5, 2, 3)) -> DataFrame:
    """Long form: one row a note and order q."""
    p = F.col("amp") * F.col("amp")
    rows = components.withColumn("p", F.try_divide(p, F.sum(p).over(Window.partitionBy("note"))))
    wide = rows.groupBy("note").agg(*[hill(F.col("p"), q).alias(f"q{i}") for i, q in enumerate(orders)])
    return wide.select("note", F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), F.col(f"q{i}").alias("d")) for i, q in enumerate(orders)])).alias("x")).select("note", "x.q", "x.d")


def merge_erb_grid(components: DataFrame, fraction: float = 1.0, keys: tuple[str, ...] = ("note", "comp")) -> DataFrame:
    """Components that share a cell of the ERB-rate grid become one: root of summed energy, energy-weighted frequency."""
    p = F.col("amp") * F.col("amp")
    cell = F.floor(erb_rate(F.col("freq_hz")) / fraction)
    out = components.groupBy(*keys, cell.alias("cell")).agg(F.sqrt(F.sum(p)).alias("amp"), F.try_divide(F.sum(p * F.col("freq_hz")), F.sum(p)).alias("freq_hz"), F.count("*").alias("merged"))
    return out


def component_density(components: DataFrame, fraction: float = 1.0) -> DataFrame:
    """Auditory component density: sum over compartments of energy share times D1 after the ERB merge.

    status says which compartments had no energy; magnitude is the note's energy per component.
    """
    merged = merge_erb_grid(components, fraction)
    p = F.col("amp") * F.col("amp")
    share = F.try_divide(p, F.sum(p).over(Window.partitionBy("note", "comp")))
    parts = merged.withColumn("p", share).groupBy("note", "comp").agg(hill(F.col("p"), 1).alias("d1"), hill(F.col("p"), 2).alias("d2"), F.sum(p).alias("e"))
    used = F.col("e") > 0
    unused = [F.when(F.count_if(used & (F.col("comp") == c)) == 0, F.lit(c)) for c in COMPARTMENTS]
    out = parts.groupBy("note").agg(
        F.try_divide(F.sum(F.when(used, F.col("e") * F.col("d1"))), F.sum(F.when(used, F.col("e")))).alias("acd"),
        F.try_divide(F.sum(F.when(used, F.col("e") * F.col("d2"))), F.sum(F.when(used, F.col("e")))).alias("acd_d2"),
        F.sum("e").alias("energy"),
        F.concat_ws(",", *unused).alias("missing"),
    )
    # The status words of the domain's tables.
    status = F.when(F.col("acd").isNull(), "no_usable_compartment").when(F.col("missing") != "", F.concat(F.lit("ok_with_unused:"), "missing")).otherwise("ok")
    return out.select("note", "acd", "acd_d2", F.try_divide("energy", "acd").alias("magnitude"), status.alias("status"))
