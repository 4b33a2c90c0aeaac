"""Queries of pairwise kernels, spectral descriptors, frames and ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonagrid.operators import descriptors, dissonance, persistence, ranges
from sonagrid.plans.catalog import query
from sonagrid.plans.inputs import COMPONENTS, SPECTRUM, components, dealt, spectrum, table, with_ctes
from sonagrid.plans.rounding import rounded, rounded_sql

_PAIRS = """pairs AS (
  SELECT x.note, least(x.f, y.f) AS f1, greatest(x.f, y.f) AS f2, CASE WHEN x.f <= y.f THEN x.a ELSE y.a END AS a1, CASE WHEN x.f <= y.f THEN y.a ELSE x.a END AS a2
  FROM ranked x JOIN ranked y ON x.note = y.note AND x.r < y.r)"""
_RANKED = "ranked AS (SELECT note, freq_hz AS f, amp AS a, row_number() OVER (PARTITION BY note ORDER BY amp DESC, freq_hz) AS r FROM components)"
_Y = "(0.24 * (f2 - f1) / (0.0207 * f1 + 18.96))"
_CURVE = f"(exp(-3.5 * {_Y}) - exp(-5.75 * {_Y}))"
_SETHARES = f"least(a1, a2) * greatest(0.0, {_CURVE})"
_VASSILAKIS = f"pow(a1 * a2, 0.1) * 0.5 * pow(2 * least(a1, a2) / (a1 + a2), 3.11) * {_CURVE}"
_CB = "((f2 - f1) / (1.72 * pow((f1 + f2) / 2, 0.65)))"
_HK = f"CASE WHEN {_CB} > 0 AND {_CB} <= 1.2 THEN a1 * a2 * pow(exp(1.0::DOUBLE) * ({_CB} / 0.25) * exp(-{_CB} / 0.25), 2) ELSE 0 END"


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dissonance.dissonance(components(spark, sf_dir))


@query(rounded_sql(with_ctes(COMPONENTS, _RANKED, _PAIRS) + f"SELECT note, count(*) AS pairs, sum({_SETHARES}) AS sethares_sum, avg({_SETHARES}) AS sethares_mean_pair, sum({_SETHARES}) / sum(least(a1, a2)) AS sethares_minamp FROM pairs GROUP BY note", "sethares_sum sethares_mean_pair sethares_minamp", "note pairs"))
def sethares_minamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_models(spark, sf_dir).select("note", "pairs", "sethares_sum", "sethares_mean_pair", "sethares_minamp"))


@query(rounded_sql(with_ctes(COMPONENTS, _RANKED, _PAIRS) + f"SELECT note, sum({_VASSILAKIS}) AS vassilakis_sum FROM pairs GROUP BY note", "vassilakis_sum"))
def vassilakis_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_models(spark, sf_dir).select("note", "vassilakis_sum"))


@query(rounded_sql(with_ctes(COMPONENTS, _RANKED, _PAIRS) + f"SELECT note, sum({_HK}) / sum(a1 * a1 + a2 * a2) AS hutchinson_knopoff FROM pairs GROUP BY note", "hutchinson_knopoff"))
def hutchinson_knopoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_models(spark, sf_dir).select("note", "hutchinson_knopoff"))


@query(
    rounded_sql(
        with_ctes(COMPONENTS, _RANKED, _PAIRS, f"m AS (SELECT note, sum({_SETHARES}) AS sethares_sum, sum({_VASSILAKIS}) AS vassilakis_sum, sum({_HK}) / sum(a1 * a1 + a2 * a2) AS hutchinson_knopoff FROM pairs GROUP BY note)")
        + "\nSELECT note, model, value FROM (SELECT note, 'sethares_sum' AS model, sethares_sum AS value FROM m UNION ALL SELECT note, 'vassilakis_sum', vassilakis_sum FROM m UNION ALL SELECT note, 'hutchinson_knopoff', hutchinson_knopoff FROM m) AS u WHERE value IS NOT NULL",
        "value",
        "note model",
    )
)
def dissonance_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonagrid.operators.relational import long_form

    return rounded(long_form(_models(spark, sf_dir), ["note"], ["sethares_sum", "vassilakis_sum", "hutchinson_knopoff"], ("model", "value")))


@query(
    rounded_sql(
        with_ctes(
            SPECTRUM,
            "x AS (SELECT a.note, a.amp AS a1, b.amp AS a2, (b.freq_hz - a.freq_hz) / (0.25 * (25 + 75 * pow(1 + 1.4 * pow(a.freq_hz / 1000, 2), 0.69))) AS x FROM spectrum a JOIN spectrum b ON a.note = b.note AND b.freq_hz > a.freq_hz)",
        )
        + "SELECT note, sum(CASE WHEN x <= 20 THEN a1 * a2 * x * exp(1 - x) ELSE 0 END) AS roughness FROM x GROUP BY note",
        "roughness",
    )
)
def roughness_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dissonance.roughness(spectrum(spark, sf_dir).withColumn("id", F.col("bin"))))


@query(
    rounded_sql(
        with_ctes(
            SPECTRUM,
            "x AS (SELECT a.note, a.amp AS a1, b.amp AS a2, (b.freq_hz - a.freq_hz) / (0.25 * (0.108 * a.freq_hz + 24.7)) AS x FROM spectrum a JOIN spectrum b ON a.note = b.note AND b.freq_hz > a.freq_hz)",
        )
        + "SELECT note, sum(CASE WHEN x <= 20 THEN a1 * a2 * x * exp(1 - x) ELSE 0 END) AS roughness FROM x GROUP BY note",
        "roughness",
    )
)
def roughness_erb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dissonance.roughness(spectrum(spark, sf_dir).withColumn("id", F.col("bin")), basis="erb"))


@query(
    rounded_sql(
        with_ctes(COMPONENTS, _RANKED, _PAIRS, f"m AS (SELECT note, sum({_SETHARES}) AS sethares_sum, sum({_VASSILAKIS}) AS vassilakis_sum, 10 * avg({_HK}) AS hutchinson_knopoff_mean_pair_scaled FROM pairs GROUP BY note)", "u AS (SELECT note, 'sethares_sum' AS model, sethares_sum AS value FROM m UNION ALL SELECT note, 'vassilakis_sum', vassilakis_sum FROM m UNION ALL SELECT note, 'hutchinson_knopoff_mean_pair_scaled', hutchinson_knopoff_mean_pair_scaled FROM m)")
        + "SELECT note, model, value, value / max(value) OVER (PARTITION BY model) AS normalised FROM u WHERE value IS NOT NULL",
        "value normalised",
        "note model",
    )
)
def dissonance_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dissonance.compare_models(components(spark, sf_dir), ("sethares_sum", "vassilakis_sum", "hutchinson_knopoff_mean_pair_scaled")))


_FIFTH = f"""met AS (SELECT a.note, least(a.freq_hz, b.freq_hz * 1.5) AS f1, greatest(a.freq_hz, b.freq_hz * 1.5) AS f2, a.amp AS a1, b.amp AS a2 FROM components a JOIN components b ON a.note = b.note),
crossed AS (SELECT note, sum({_SETHARES}) AS crossed FROM met GROUP BY note),
low AS (SELECT note, sum({_SETHARES}) AS low FROM pairs GROUP BY note),
high AS (SELECT note, sum({_SETHARES}) AS high FROM (SELECT note, 1.5 * f1 AS f1, 1.5 * f2 AS f2, a1, a2 FROM pairs) GROUP BY note)"""


@query(
    rounded_sql(
        with_ctes(COMPONENTS, _RANKED, _PAIRS, _FIFTH)
        + "SELECT note, crossed, crossed + coalesce(low, 0) + coalesce(high, 0) AS full_sum, coalesce(low, 0) AS intrinsic, crossed + coalesce(high, 0) AS added FROM crossed LEFT JOIN low USING (note) LEFT JOIN high USING (note)",
        "crossed full_sum intrinsic added",
    )
)
def same_timbre_fifth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dissonance.same_timbre(dealt(spark, sf_dir, components(spark, sf_dir)), 1.5).withColumnsRenamed({"cross": "crossed", "full": "full_sum"}))


#: A coarse table of the standard curve, for the lookup query.
_CURVE_POINTS = [(0.0, 0.0), (0.1, 0.54), (0.25, 1.0), (0.5, 0.54), (0.8, 0.12), (1.2, 0.0)]


@query(
    rounded_sql(
        with_ctes(
            COMPONENTS,
            _RANKED,
            _PAIRS,
            "points AS (SELECT * FROM (VALUES (0.0::DOUBLE, 0.0::DOUBLE, 0.1::DOUBLE, 0.54::DOUBLE), (0.1, 0.54, 0.25, 1.0), (0.25, 1.0, 0.5, 0.54), (0.5, 0.54, 0.8, 0.12), (0.8, 0.12, 1.2, 0.0)) AS p(y0, g0, y1, g1))",
            "y AS (SELECT note, (f2 - f1) / CASE WHEN (f1 + f2) / 2 < 200 THEN 25 + 75 * pow(1 + 1.4 * pow((f1 + f2) / 2000, 2), 0.69) ELSE 1.72 * pow((f1 + f2) / 2, 0.65) END AS y, a1 * a2 AS a FROM pairs)",
        )
        + "SELECT note, sum(a * coalesce(g0 + (y - y0) * (g1 - g0) / (y1 - y0), 0)) AS looked_up FROM y LEFT JOIN points ON y > y0 AND y <= y1 GROUP BY note",
        "looked_up",
    )
)
def dissonance_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of a1 a2 g(y) with g interpolated in a table and the bandwidth by Zwicker below 200 Hz."""
    near = dissonance.partial_pairs(components(spark, sf_dir))
    y = (F.col("f2") - F.col("f1")) / dissonance.critical_bandwidth((F.col("f1") + F.col("f2")) / 2, 200.0)
    found = near.groupBy("note").agg(F.sum(F.col("a1") * F.col("a2") * dissonance.table_lookup(y, _CURVE_POINTS)).alias("looked_up"))
    pairs = components(spark, sf_dir).groupBy("note").count().filter("count > 1").select("note")
    return rounded(pairs.join(found, "note", "left").fillna(0.0))


_SWEEP = f"""c AS (SELECT note, step, sum({_SETHARES}) AS dissonance FROM (
  SELECT a.note, step, least(a.freq_hz, b.freq_hz * (1 + step * (1.0::DOUBLE / 99))) AS f1, greatest(a.freq_hz, b.freq_hz * (1 + step * (1.0::DOUBLE / 99))) AS f2, a.amp AS a1, b.amp AS a2
  FROM components a JOIN components b ON a.note = b.note, (SELECT CAST(unnest(range(0, 100)) AS INTEGER) AS step)) GROUP BY note, step)"""


@query(rounded_sql(with_ctes(COMPONENTS, _SWEEP) + "SELECT note, step, dissonance, 1 + step * (1.0::DOUBLE / 99) AS interval_ratio FROM c", "dissonance interval_ratio", "note step"))
def dissonance_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dissonance.curve(components(spark, sf_dir)).withColumnRenamed("interval", "interval_ratio"))


@query(rounded_sql(with_ctes(COMPONENTS, _SWEEP, "g AS (SELECT *, lag(dissonance) OVER w AS l, lead(dissonance) OVER w AS r FROM c WINDOW w AS (PARTITION BY note ORDER BY step))") + "SELECT note, step FROM g WHERE dissonance < l - 1e-9 AND dissonance < r - 1e-9", "", "note step"))
def dissonance_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dissonance.scale(dissonance.curves(components(spark, sf_dir)))


@query(
    rounded_sql(
        with_ctes(
            SPECTRUM,
            "m AS (SELECT note, sum(amp * freq_hz) / sum(amp) AS c FROM spectrum GROUP BY note)",
            "v AS (SELECT note, c, sqrt(sum(amp * pow(freq_hz - c, 2)) / sum(amp)) AS s FROM spectrum JOIN m USING (note) GROUP BY note, c)",
        )
        + "SELECT note, c AS centroid_hz, s AS spread_hz, sum(amp * pow((freq_hz - c) / s, 3)) / sum(amp) AS skewness, sum(amp * pow((freq_hz - c) / s, 4)) / sum(amp) AS kurtosis FROM spectrum JOIN v USING (note) GROUP BY note, c, s",
        "centroid_hz spread_hz skewness kurtosis",
        digits=5,
    )
)
def mir_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(descriptors.moments(spectrum(spark, sf_dir)), 5)


@query(
    rounded_sql(
        with_ctes(SPECTRUM, "c AS (SELECT note, freq_hz, sum(amp * amp) OVER (PARTITION BY note ORDER BY freq_hz) AS upto, sum(amp * amp) OVER (PARTITION BY note) AS whole FROM spectrum)")
        + "SELECT note, min(freq_hz) FILTER (WHERE upto >= 0.85 * whole - 1e-12) AS rolloff_85, min(freq_hz) FILTER (WHERE upto >= 0.95 * whole - 1e-12) AS rolloff_95 FROM c GROUP BY note",
        "rolloff_85 rolloff_95",
    )
)
def rolloff_85_95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(descriptors.rolloff(spectrum(spark, sf_dir)))


@query(rounded_sql(with_ctes(SPECTRUM) + "SELECT note, sum(CASE WHEN bin = 0 THEN amp ELSE 0 END) / sum(amp) AS t1, sum(CASE WHEN bin BETWEEN 1 AND 3 THEN amp ELSE 0 END) / sum(amp) AS t2, sum(CASE WHEN bin >= 4 THEN amp ELSE 0 END) / sum(amp) AS t3 FROM spectrum GROUP BY note", "t1 t2 t3"))
def tristimulus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(descriptors.tristimulus(spectrum(spark, sf_dir)))


@query(
    rounded_sql(
        with_ctes(SPECTRUM, "p AS (SELECT note, CASE WHEN amp > 0 THEN amp * amp END AS p FROM spectrum)", "q AS (SELECT note, p, p / sum(p) OVER (PARTITION BY note) AS q FROM p)")
        + "SELECT note, exp(avg(ln(p))) / avg(p) AS flatness, -sum(q * ln(q)) / ln(count(q)) AS entropy FROM q GROUP BY note",
        "flatness entropy",
    )
)
def flatness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(descriptors.flatness_entropy(spectrum(spark, sf_dir)))


@query(rounded_sql(with_ctes(SPECTRUM, "s AS (SELECT note, amp, abs(lead(amp) OVER (PARTITION BY note ORDER BY bin) - amp) AS step FROM spectrum)") + "SELECT note, coalesce(sum(step), 0) / sum(amp) AS irregularity FROM s GROUP BY note", "irregularity"))
def irregularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(descriptors.irregularity(spectrum(spark, sf_dir)))


@query(rounded_sql(with_ctes(SPECTRUM, "b AS (SELECT note, floor(21.4 * log10(1 + 0.00437 * freq_hz)) AS band, sum(amp * amp) AS p FROM spectrum GROUP BY ALL)") + "SELECT note, pow(sum(p), 2) / sum(p * p) AS erb_density, count(*) AS bands FROM b GROUP BY note", "erb_density", "note bands"))
def erb_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(descriptors.erb_density(spectrum(spark, sf_dir)))


@query(
    rounded_sql(
        with_ctes(
            SPECTRUM,
            "z AS (SELECT note, amp * amp AS p, 13 * atan(0.00076 * freq_hz) + 3.5 * atan(pow(freq_hz / 7500, 2)) AS z FROM spectrum)",
            "e AS (SELECT note, floor(z) + i AS band, p * greatest(0.0, 1 - abs(z - (floor(z) + i))) AS e FROM z, (SELECT unnest([0, 1]) AS i))",
            "b AS (SELECT note, band, sum(e) AS e FROM e WHERE band BETWEEN 0 AND 24 GROUP BY ALL HAVING sum(e) > 0)",
            "q AS (SELECT note, e / sum(e) OVER (PARTITION BY note) AS q FROM b)",
        )
        + "SELECT note, 0.6 * count(*) / 25 + 0.4 * CASE WHEN count(*) > 1 THEN -sum(q * ln(q)) / ln(count(*)) ELSE 0 END AS perceptual_density FROM q GROUP BY note",
        "perceptual_density",
    )
)
def bark_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(descriptors.bark_occupancy(spectrum(spark, sf_dir)))


@query(
    rounded_sql(
        with_ctes(SPECTRUM, "k AS (SELECT note, amp, row_number() OVER (PARTITION BY note ORDER BY amp DESC, freq_hz) AS k, max(amp) OVER (PARTITION BY note) AS top FROM spectrum)")
        + "SELECT note, sum(CASE WHEN k <= 5 THEN amp ELSE 0 END) / sum(amp) AS concentration, 1 - avg(CASE WHEN amp > 0.01 * top THEN 1.0 ELSE 0.0 END) AS sparsity FROM k GROUP BY note",
        "concentration sparsity",
    )
)
def concentration_sparsity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(descriptors.concentration(spectrum(spark, sf_dir)))


# Frames ------------------------------------------------------------------------------------------

_DB = "f AS (SELECT label AS note, note AS frame, bin, freq_hz, 20 * log10(greatest(amp, 1e-12)) AS db FROM spectrum)"
_PEAKS = """k AS (SELECT *, lag(db) OVER w AS l, lead(db) OVER w AS r, quantile_cont(db, 0.5) OVER (PARTITION BY note, frame) AS m FROM f WINDOW w AS (PARTITION BY note, frame ORDER BY bin)),
peaks AS (SELECT note, frame, bin, freq_hz FROM k WHERE db > l AND db > r AND db >= m + 6)"""


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectrum(spark, sf_dir).select(F.col("label").alias("note"), F.col("note").alias("frame"), "bin", "freq_hz", (20 * F.log10(F.greatest("amp", F.lit(1e-12)))).alias("db"))


@query(with_ctes(SPECTRUM, _DB, _PEAKS) + "SELECT note, frame, bin FROM peaks")
def frame_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return persistence.frame_peaks(_frames(spark, sf_dir)).select("note", "frame", "bin")


@query(
    rounded_sql(
        with_ctes(SPECTRUM, _DB, _PEAKS, "t AS (SELECT DISTINCT note, freq_hz FROM f)")
        + "SELECT t.note, t.freq_hz, count(DISTINCT frame) / 50.0 AS persistence FROM t LEFT JOIN peaks p ON p.note = t.note AND abs(p.freq_hz - t.freq_hz) <= 120 GROUP BY t.note, t.freq_hz",
        "freq_hz persistence",
    )
)
def persistence_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _frames(spark, sf_dir)
    return rounded(persistence.persistence(frames.select("note", "freq_hz").distinct(), persistence.frame_peaks(frames), 50, 120.0))


@query(
    with_ctes(
        "g AS (SELECT user_id, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 86400 THEN 1 WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS fresh FROM events)",
        "s AS (SELECT user_id, ts, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM g)",
    )
    + "SELECT user_id, segment, min(ts) AS started, max(ts) AS ended, count(*) AS samples FROM s GROUP BY user_id, segment"
)
def session_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return persistence.segments(table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", 86400.0)


@query(
    with_ctes(
        "w AS (SELECT event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) - i AS w, count(*) AS n FROM events, (SELECT unnest([0, 1, 2, 3]) AS i) GROUP BY ALL)",
    )
    + "SELECT event_type, count(*) AS windows, CAST(sum(n) AS BIGINT) AS samples FROM w GROUP BY event_type"
)
def stft_frames_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return persistence.hopped_activity(rows, "ts", "event_type", "4 hours", "1 hour")


@query(
    rounded_sql(
        with_ctes(SPECTRUM, "p AS (SELECT note, bin, amp * amp AS p FROM spectrum)", "q AS (SELECT note, bin, p, 1.3 * quantile_cont(p, 0.15) OVER (PARTITION BY note ORDER BY bin ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS floor FROM p)")
        + "SELECT note, bin, floor, greatest(0.0, p - floor) AS gated FROM q",
        "floor gated",
        "note bin",
    )
)
def noise_floor_rolling_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(persistence.rolling_floor(spectrum(spark, sf_dir)).select("note", "bin", "floor", "gated"))


@query(
    rounded_sql(
        with_ctes(
            SPECTRUM,
            "p AS (SELECT note, bin, amp * amp AS p FROM spectrum)",
            "c AS (SELECT note, bin, p, list_sort(list_concat(coalesce(list(p) OVER (PARTITION BY note ORDER BY bin ROWS BETWEEN 66 PRECEDING AND 3 PRECEDING), []), coalesce(list(p) OVER (PARTITION BY note ORDER BY bin ROWS BETWEEN 3 FOLLOWING AND 66 FOLLOWING), []))) AS cells FROM p)",
            "k AS (SELECT note, bin, p, cells[1:greatest(1, CAST(floor(len(cells) * 0.75) AS BIGINT))] AS kept FROM c)",
            "t AS (SELECT note, bin, p, len(kept) * (pow(0.01, -1.0 / len(kept)) - 1) * list_sum(kept) / len(kept) AS threshold FROM k)",
        )
        + "SELECT note, bin, threshold, CASE WHEN p > 0 AND threshold > 0 THEN 10 * log10(p / threshold) END AS margin_db, p >= threshold AS detected FROM t",
        "threshold margin_db",
        "note bin detected",
    )
)
def cfar_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(persistence.cfar(spectrum(spark, sf_dir)).select("note", "bin", "threshold", "margin_db", "detected"))


@query(
    rounded_sql(
        with_ctes(
            SPECTRUM,
            "y AS (SELECT note, bin, ln(greatest(amp, 1e-12)) AS y FROM spectrum)",
            "g AS (SELECT *, lag(y) OVER w AS l, lead(y) OVER w AS r FROM y WINDOW w AS (PARTITION BY note ORDER BY bin))",
            "s AS (SELECT *, 0.5 * (l - r) / (l - 2 * y + r) AS shift FROM g WHERE y > l AND y > r)",
        )
        + "SELECT note, bin, bin + shift AS position, exp(y - 0.25 * (l - r) * shift) AS height FROM s",
        "position height",
        "note bin",
    )
)
def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(persistence.local_maxima(spectrum(spark, sf_dir)))


@query(
    rounded_sql(
        with_ctes(
            SPECTRUM,
            "y AS (SELECT note, bin, 20 * log10(greatest(amp, 1e-12)) AS db FROM spectrum)",
            "g AS (SELECT *, lag(db) OVER w AS l, lead(db) OVER w AS r, min(db) OVER (PARTITION BY note ORDER BY bin ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS lo, min(db) OVER (PARTITION BY note ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS hi FROM y WINDOW w AS (PARTITION BY note ORDER BY bin))",
        )
        + "SELECT note, bin, db - greatest(lo, hi) AS prominence_db FROM g WHERE db > l AND db > r",
        "prominence_db",
        "note bin",
    )
)
def saddle_prominence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(persistence.prominence(spectrum(spark, sf_dir)))


# Ranges ------------------------------------------------------------------------------------------

_INTERVALS = "i AS (SELECT l_suppkey AS grp, l_quantity * 100 AS lo, l_quantity * 100 + 40 * l_linenumber AS hi FROM lineitem)"


@query(
    rounded_sql(
        with_ctes(
            _INTERVALS,
            "b AS (SELECT *, max(hi) OVER (PARTITION BY grp ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i)",
            "p AS (SELECT *, sum(CASE WHEN before IS NULL OR lo > before THEN 1 ELSE 0 END) OVER (PARTITION BY grp ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS part FROM b)",
            "e AS (SELECT grp, part, min(lo) AS lo, max(hi) AS hi FROM p GROUP BY grp, part)",
        )
        + "SELECT grp, sum(hi - lo) AS covered, count(*) AS parts FROM e GROUP BY grp",
        "covered",
        "grp parts",
    )
)
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("grp"), (F.col("l_quantity") * 100).alias("lo"), (F.col("l_quantity") * 100 + 40 * F.col("l_linenumber")).alias("hi"))
    return rounded(ranges.covered_length(rows, ["grp"], "lo", "hi"))


TIERS = [(5000.0 * i, 5000.0 * (i + 1), f"tier_{i:02d}") for i in range(90)]


@query(
    "SELECT o_orderkey AS note, CASE WHEN o_totalprice > 0 AND o_totalprice <= 450000 THEN 'tier_' || lpad(CAST(CAST(ceil(o_totalprice / 5000) - 1 AS BIGINT) AS VARCHAR), 2, '0') END AS tier FROM orders"
)
def tier_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("note"), "o_totalprice")
    return ranges.lookup_interval(rows, F.col("o_totalprice"), TIERS, ("tier", "upper")).select("note", "tier")


@query(
    with_ctes(COMPONENTS)
    + "SELECT note, count(*) AS n FROM components r WHERE comp = 'I' AND NOT EXISTS (SELECT 1 FROM components h WHERE h.note = r.note AND h.comp = 'H' AND h.include AND abs(h.freq_hz - r.freq_hz) <= 150) GROUP BY note"
)
def leakage_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonagrid.operators.classify import residual_rows

    return residual_rows(components(spark, sf_dir)).groupBy("note").agg(F.count("*").alias("n"))


@query(
    rounded_sql(
        with_ctes(
            COMPONENTS,
            "r AS (SELECT DISTINCT note, freq_hz FROM components WHERE comp <> 'H')",
            "h AS (SELECT DISTINCT note, freq_hz AS slot FROM components WHERE comp = 'H')",
            "m AS (SELECT r.note, r.freq_hz, h.slot, row_number() OVER (PARTITION BY r.note, r.freq_hz ORDER BY abs(r.freq_hz - h.slot), h.slot) AS k FROM r JOIN h ON r.note = h.note AND abs(r.freq_hz - h.slot) <= 400)",
        )
        + "SELECT note, freq_hz, slot FROM m WHERE k = 1",
        "freq_hz slot",
    )
)
def nearest_harmonic_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = components(spark, sf_dir)
    r = rows.filter("comp <> 'H'").select("note", "freq_hz").distinct()
    h = rows.filter("comp = 'H'").select("note", F.col("freq_hz").alias("slot")).distinct()
    return rounded(ranges.nearest(r, h, ["note"], "freq_hz", "slot", 400.0, []))
