"""Queries of a note's regions: peaks are line items, of several kinds so that all regions occur."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonagrid.operators import regions
from sonagrid.plans.catalog import query
from sonagrid.plans.inputs import COMPONENTS, SPECTRUM, components, dealt, spectrum, with_ctes
from sonagrid.plans.rounding import rounded, rounded_sql


def _peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    freq = F.when(F.col("status") == "floor", 18.0 + 7.5 * n).when(n % 2 == 1, F.col("peak_hz")).otherwise(F.col("freq_hz"))
    return dealt(spark, sf_dir, components(spark, sf_dir).select("note", "f0_hz", freq.alias("freq_hz"), (F.col("amp") * F.col("amp")).alias("power")))


_PEAKS = "peaks AS (SELECT note, f0_hz, CASE WHEN status = 'floor' THEN 18.0::DOUBLE + 7.5::DOUBLE * n WHEN n % 2 = 1 THEN peak_hz ELSE freq_hz END AS freq_hz, amp * amp AS power FROM components)"
_REGIONS = (
    "r0 AS (SELECT *, max(power) OVER (PARTITION BY note) AS top FROM peaks WHERE freq_hz BETWEEN 20 AND 20000)",
    "r1 AS (SELECT *, lead(freq_hz) OVER (PARTITION BY note ORDER BY freq_hz, power) - freq_hz AS step, lag(power) OVER (PARTITION BY note ORDER BY freq_hz, power) AS before, lead(power) OVER (PARTITION BY note ORDER BY freq_hz, power) AS after, count(*) OVER (PARTITION BY note) AS rows_ FROM r0 WHERE power >= top * 1e-8 AND top > 0)",
    "r2 AS (SELECT *, coalesce(quantile_cont(CASE WHEN step > 1e-12 THEN step END, 0.5) OVER (PARTITION BY note), f0_hz / 8) AS step_hz, round_even(freq_hz / f0_hz, 0) AS o FROM r1)",
    "r3 AS (SELECT *, o * f0_hz AS slot, greatest(step_hz, least(greatest(o * f0_hz * 30 / 1200, step_hz), 0.3 * f0_hz)) AS tol FROM r2)",
    "r4 AS (SELECT *, CASE WHEN freq_hz < greatest(20.0, least(f0_hz / 2, 80.0)) THEN 'S' WHEN o >= 1 AND abs(1200 * log2(freq_hz / CASE WHEN o >= 1 THEN slot ELSE 1 END)) <= 1200 * tol / CASE WHEN o >= 1 THEN slot ELSE 1 END THEN 'H' ELSE 'I' END AS region FROM r3)",
    "regions AS (SELECT *, region = 'H' AND row_number() OVER (PARTITION BY note, region, o ORDER BY power DESC, freq_hz) = 1 AS loudest, greatest(0.0, least(1.0, (10 * log10(power / top) + 60) / 60)) AS salience, rows_ = 1 OR coalesce(power > before AND power >= after, false) AS peak, floor(1200 * log2(freq_hz / 20) / 25) AS log_bin FROM r4)",
)
_DESCRIPTORS = (
    "u0 AS (SELECT *, CASE region WHEN 'H' THEN slot <= 12000 WHEN 'I' THEN freq_hz <= 12000 ELSE peak AND freq_hz <= 12000 END AS counted, CASE region WHEN 'H' THEN o WHEN 'I' THEN log_bin ELSE freq_hz END AS unit, CASE WHEN region = 'H' AND NOT loudest THEN 0 ELSE power END AS e, CASE WHEN freq_hz <= 5000 THEN sqrt(power) / (1 + pow(freq_hz / 1500, 2)) END AS w FROM regions)",
    "u AS (SELECT note, region, unit, max(f0_hz) AS f0_hz, max(step_hz) AS step_hz, max(salience) FILTER (WHERE counted) AS salience, sum(e) AS e, sum(e) FILTER (WHERE freq_hz <= 5000) AS e_body, sum(power) FILTER (WHERE counted AND region = 'S') AS low, sum(power) AS p, sum(power * power) AS pp, sum(w) AS w, sum(w * w) AS ww FROM u0 GROUP BY note, region, unit)",
    "n0 AS (SELECT note, max(f0_hz) AS f0_hz, max(step_hz) AS step_hz, coalesce(sum(low), 0) AS body_s, count(*) FILTER (WHERE region = 'H') AS orders_found, coalesce(pow(sum(w), 2) / sum(ww), 0) AS body_effective, "
    + ", ".join(
        f"coalesce(sum(e) FILTER (WHERE region = '{r}'), 0) AS e_{c}, coalesce(sum(salience) FILTER (WHERE region = '{r}'), 0) AS density_{c}, count(*) FILTER (WHERE region = '{r}' AND salience > 0) AS count_{c}, coalesce(pow(sum(p) FILTER (WHERE region = '{r}'), 2) / sum(pp) FILTER (WHERE region = '{r}'), 0) AS effective_{c}"
        for r, c in zip("HIS", "his", strict=True)
    )
    + ", coalesce(sum(e_body) FILTER (WHERE region = 'H'), 0) AS body_h, coalesce(sum(e_body) FILTER (WHERE region = 'I'), 0) AS body_i FROM u GROUP BY note)",
    "n1 AS (SELECT *, e_h / nullif(e_h + e_i + e_s, 0) AS share_h, e_i / nullif(e_h + e_i + e_s, 0) AS share_i, e_s / nullif(e_h + e_i + e_s, 0) AS share_s, CAST(floor(12000 / f0_hz) AS BIGINT) AS expected_h, CAST(ceil(1200 * log2(12000 / greatest(20.0, least(f0_hz / 2, 80.0))) / 25) AS BIGINT) AS expected_i, CAST(ceil(greatest(0.0, least(f0_hz / 2, 80.0) - 20) / greatest(1.0, step_hz)) AS BIGINT) AS expected_s, least(1.0, orders_found / (floor(20000 / f0_hz) - greatest(1, ceil(20 / f0_hz)) + 1)) AS occupancy FROM n0)",
    "n2 AS (SELECT *, " + ", ".join(f"CASE WHEN expected_{c} > 0 THEN greatest(0.0, least(1.0, density_{c} / expected_{c})) + 0.25 * greatest(0.0, least(1.0, count_{c} / expected_{c})) ELSE 0 END AS strength_{c}" for c in "his") + ", concat_ws('|', CASE WHEN expected_h <= 0 THEN 'h' END, CASE WHEN expected_i <= 0 THEN 'i' END, CASE WHEN expected_s <= 0 THEN 's' END) AS no_slots FROM n1)",
    "n3 AS (SELECT *, " + ", ".join(f"strength_{c} * coalesce(share_{c}, 1.0 / 3) AS gated_{c}" for c in "his") + " FROM n2)",
    "n4 AS (SELECT *, " + ", ".join(f"CASE WHEN gated_h + gated_i + gated_s > 1e-12 THEN gated_{c} / (gated_h + gated_i + gated_s) ELSE {d}::DOUBLE / 7 END AS weight_{c}" for c, d in zip("his", (4, 2, 1), strict=True)) + " FROM n3)",
    "n5 AS (SELECT *, weight_h * body_h + weight_i * body_i + weight_s * body_s AS total_body, weight_h * e_h + weight_i * e_i + weight_s * body_s AS total_full FROM n4)",
)


def _sql(select: str, doubles: str, others: str) -> str:
    return rounded_sql(with_ctes(COMPONENTS, _PEAKS, *_REGIONS, *_DESCRIPTORS) + f"SELECT {select} FROM n5", doubles, others)


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.descriptors(_peaks(spark, sf_dir))


def _names(columns: str) -> list[str]:
    return columns.split()


_ENERGY = "e_h e_i e_s share_h share_i share_s occupancy"


@query(_sql("*", _ENERGY, "note orders_found"))
def region_energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_all(spark, sf_dir).select("note", "orders_found", *_names(_ENERGY)))


_SALIENCE = "density_h density_i density_s effective_h effective_i effective_s body_effective"


@query(_sql("*", _SALIENCE, "note count_h count_i count_s"))
def region_salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_all(spark, sf_dir).select("note", "count_h", "count_i", "count_s", *_names(_SALIENCE)))


_STRENGTH = "strength_h strength_i strength_s gated_h gated_i gated_s"


@query(_sql("*", _STRENGTH, "note expected_h expected_i expected_s no_slots"))
def register_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_all(spark, sf_dir).select("note", "expected_h", "expected_i", "expected_s", "no_slots", *_names(_STRENGTH)))


_TOTALS = "weight_h weight_i weight_s total_body total_full extension_index density_count density_salience effective_weighted upper_activity"


@query(
    _sql(
        "*, total_full / greatest(total_body, 1e-12) AS extension_index, weight_h * count_h + weight_i * count_i + weight_s * count_s AS density_count, weight_h * density_h + weight_i * density_i + weight_s * density_s AS density_salience, coalesce(effective_h * share_h + effective_i * share_i + effective_s * share_s, 0) AS effective_weighted, coalesce((e_h - body_h + e_i - body_i) / nullif(e_h + e_i, 0), 0) AS upper_activity",
        _TOTALS,
        "note",
    )
)
def observed_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_all(spark, sf_dir).select("note", *_names(_TOTALS)))


@query(rounded_sql(with_ctes(COMPONENTS, _PEAKS, *_REGIONS) + "SELECT note, freq_hz, region, step_hz, tol AS tolerance_hz, loudest FROM regions", "freq_hz step_hz tolerance_hz", "note region loudest"))
def three_way_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(regions.regions(_peaks(spark, sf_dir)).select("note", "freq_hz", "region", "step_hz", "tolerance_hz", "loudest"))


@query(rounded_sql(with_ctes(COMPONENTS) + "SELECT note, coalesce(pow(sum(amp * amp) FILTER (WHERE comp = 'H'), 2) / sum(pow(amp, 4)) FILTER (WHERE comp = 'H'), 0) AS fatness_h, coalesce(pow(sum(amp * amp), 2) / sum(pow(amp, 4)), 0) AS fatness FROM components GROUP BY note", "fatness_h fatness"))
def fatness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(regions.pooled_fatness(components(spark, sf_dir)))


@query(
    rounded_sql(
        with_ctes(
            SPECTRUM,
            "s AS (SELECT *, 170.0::DOUBLE + note % 300 AS f0_hz, avg(amp) OVER (PARTITION BY note) AS mean FROM spectrum)",
            "m AS (SELECT *, coalesce(sum(amp) OVER (PARTITION BY note ORDER BY freq_hz ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 0) / 3 AS smooth, sum(amp * amp) OVER (PARTITION BY note) AS whole, greatest(1, round_even(freq_hz / f0_hz, 0)) AS o FROM s)",
            "q AS (SELECT *, CASE WHEN amp * amp / whole > 1e-10 THEN amp * amp / whole END AS q FROM m)",
            "c AS (SELECT note, avg(abs(amp - smooth)) / avg(amp) AS irregularity, 1 - coalesce(sum(amp * amp) FILTER (WHERE abs(freq_hz - o * f0_hz) <= 0.03 * o * f0_hz), 0) / sum(amp * amp) AS off_harmonic, -sum(q * ln(q)) / ln(count(q)) AS entropy FROM q GROUP BY note)",
        )
        + "SELECT note, irregularity, off_harmonic, entropy, greatest(0.0, least(1.0, 0.4 * irregularity + 0.4 * off_harmonic + 0.2 * entropy)) AS complexity FROM c",
        "irregularity off_harmonic entropy complexity",
    )
)
def spectral_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra of 64 bins: the moving mean runs over three."""
    return rounded(regions.spectral_complexity(spectrum(spark, sf_dir).withColumn("f0_hz", 170.0 + F.col("note") % 300)))
