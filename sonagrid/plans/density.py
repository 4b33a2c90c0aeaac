"""Queries of the density and diversity families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonagrid.functions import phi
from sonagrid.operators import density
from sonagrid.plans.catalog import query
from sonagrid.plans.inputs import COMPONENTS, SPECTRUM, components, dealt, spectrum, with_ctes
from sonagrid.plans.rounding import rounded, rounded_sql

PHI_SQL = {
    "linear": "{0}",
    "sqrt": "sqrt({0})",
    "squared": "{0} * {0}",
    "cbrt": "cbrt({0})",
    "cubic": "{0} * {0} * {0}",
    "log": "ln(1 + {0})",
    "exponential": "exp(least({0}, 50.0)) - 1",
    "inverse_log": "1.0 / (ln(1 + {0}) + 1e-10)",
}
_NEFF = "coalesce(pow(sum({0}), 2) / nullif(sum({0} * {0}), 0), 0)"


def _scores_sql(name: str) -> str:
    return (
        with_ctes(
            COMPONENTS,
            f"s AS (SELECT note, comp, amp, {PHI_SQL[name].format('amp')} AS s FROM components)",
            f"k AS (SELECT note, comp, count(*) FILTER (WHERE s > 0) AS n, sum(s) AS mass, {_NEFF.format('s')} AS n_eff, sum(amp * amp) AS e FROM s GROUP BY note, comp)",
            "p AS (SELECT *, e / sum(e) OVER (PARTITION BY note) AS share, n_eff / n AS penalty FROM k)",
        )
        + "SELECT note, comp, n AS count, mass, n_eff, share, penalty, share * mass * penalty AS strict, share * mass * pow(penalty, 0.5) AS balanced FROM p"
    )


@query(rounded_sql(with_ctes(f"p_ AS ({_scores_sql('log')})") + "SELECT note, sum(strict) AS strict, sum(balanced) AS balanced FROM p_ GROUP BY note", "strict balanced"))
def ewsd_strict_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density.note_scores(components(spark, sf_dir)))


@query(rounded_sql(_scores_sql("sqrt"), "mass n_eff share penalty strict balanced", "note comp count"))
def compartment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density.compartment_scores(components(spark, sf_dir), "sqrt").drop("energy"))


@query(rounded_sql(with_ctes(f"p_ AS ({_scores_sql('log')})") + "SELECT note, sum(share * mass * penalty) AS strict, sum(share * mass * pow(penalty, 0.5)) AS balanced FROM p_ GROUP BY note", "strict balanced"))
def ewsd_from_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density.merge_scores(density.compartment_scores(components(spark, sf_dir)).select("note", "share", "mass", "penalty")))


@query(
    rounded_sql(
        with_ctes(COMPONENTS, "t AS (SELECT note, " + ", ".join(f"sum({s.format('amp')}) AS {k}" for k, s in PHI_SQL.items()) + " FROM components GROUP BY note)")
        + "\nSELECT note, phi, value FROM (" + " UNION ALL ".join(f"SELECT note, '{k}' AS phi, {k} AS value FROM t" for k in PHI_SQL) + ") AS u",
        "value",
        "note phi",
    )
)
def ewsd_by_phi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All weight functions in one pass, in long form."""
    wide = components(spark, sf_dir).groupBy("note").agg(*[F.sum(phi.phi(k, F.col("amp"))).alias(k) for k in phi.PHI])
    return rounded(wide.unpivot(["note"], list(phi.PHI), "phi", "value"))


def _register_phi(name: str) -> None:
    sql = rounded_sql(with_ctes(COMPONENTS) + f"SELECT note, comp, sum({PHI_SQL[name].format('amp')}) AS mass FROM components GROUP BY note, comp", "mass", "note comp")

    def one(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(components(spark, sf_dir).groupBy("note", "comp").agg(F.sum(phi.phi(name, F.col("amp"))).alias("mass")))

    query(sql, f"phi_{name}")(one)


for _name in PHI_SQL:
    _register_phi(_name)


@query(
    rounded_sql(
        with_ctes(COMPONENTS, "w AS (SELECT *, max(amp) OVER (PARTITION BY note) AS top FROM components)")
        + f"""SELECT note, sum(ln(1 + amp)) AS d3, sum(ln(1 + amp)) * {_NEFF.format('(amp * amp)')} / count(*) AS d10,
  ln(1 + sum(amp * amp)) * ln(1 + {_NEFF.format('(amp * amp)')}) AS d17,
  sum(CASE WHEN amp >= 0.01 * top AND freq_hz <= 12000 THEN ln(1 + amp) ELSE 0 END) AS d24 FROM w GROUP BY note""",
        "d3 d10 d17 d24",
    )
)
def d3_d10_d17_d24(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density.discrete_bundle(components(spark, sf_dir)))


_BANDS = ", ".join(f"coalesce(sum(amp) FILTER (WHERE comp = '{c}'), 0) AS {c.lower()}" for c in "HIS")
_ENERGIES = ", ".join(f"coalesce(sum(amp * amp) FILTER (WHERE comp = '{c}'), 0) AS e_{c.lower()}" for c in "HIS")


@query(rounded_sql(with_ctes(COMPONENTS, f"b AS (SELECT note, {_BANDS} FROM components GROUP BY note)") + "SELECT note, ln(1 + h) AS h, ln(1 + i) AS i, ln(1 + s) AS s, ln(1 + h) + ln(1 + i) + ln(1 + s) AS total FROM b", "h i s total"))
def his_sums_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density.band_sums(components(spark, sf_dir), "log"))


@query(rounded_sql(with_ctes(COMPONENTS, f"b AS (SELECT note, {_ENERGIES} FROM components GROUP BY note)") + "SELECT note, e_h / (e_h + e_i + e_s) AS r_h, e_i / (e_h + e_i + e_s) AS r_i, e_s / (e_h + e_i + e_s) AS r_s FROM b", "r_h r_i r_s"))
def energy_ratio_triple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density.energy_shares(components(spark, sf_dir)))


@query(rounded_sql(with_ctes(COMPONENTS, "b AS (SELECT note, comp, sum(ln(1 + amp)) AS d, sum(amp * amp) AS e FROM components GROUP BY note, comp)") + "SELECT note, sum(d * e) / sum(e) AS density FROM b GROUP BY note", "density"))
def note_density_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density.weighted_density(components(spark, sf_dir)))


@query(
    rounded_sql(
        with_ctes(COMPONENTS, "p AS (SELECT note, amp * amp AS pooled, CASE WHEN comp = 'H' THEN amp * amp END AS harmonic, CASE WHEN comp = 'H' AND include THEN amp * amp END AS validated FROM components)")
        + f"SELECT note, {', '.join(_NEFF.format(c) + ' AS ' + c for c in ('harmonic', 'validated', 'pooled'))} FROM p GROUP BY note",
        "harmonic validated pooled",
    )
)
def neff_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density.effective_counts(components(spark, sf_dir)))


@query(rounded_sql(with_ctes(COMPONENTS, "w AS (SELECT note, ln(1 + amp / max(amp) OVER (PARTITION BY note) / (pow(n, -1.5) + 1e-12)) AS x FROM components)") + "SELECT note, sum(x) AS compensated, avg(x) AS per_component FROM w GROUP BY note", "compensated per_component"))
def rolloff_compensated_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density.rolloff_compensated(components(spark, sf_dir)))


@query(rounded_sql(with_ctes(COMPONENTS) + "SELECT note, sum(amp * amp) / max(amp * amp) AS density, sum(amp * amp) / (max(amp * amp) * count(*)) AS per_component, sum(amp * amp) AS mass FROM components WHERE comp = 'H' GROUP BY note", "density per_component mass"))
def effective_power_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density.effective_power_density(components(spark, sf_dir)))


@query(rounded_sql(with_ctes(COMPONENTS) + "SELECT note, least(1.0, count(DISTINCT round_even(peak_hz / f0_hz, 0)) / floor(4000.0 / max(f0_hz))) AS occupancy, CAST(floor(4000.0 / max(f0_hz)) AS BIGINT) AS slots FROM components WHERE comp = 'H' AND include GROUP BY note", "occupancy", "note slots"))
def harmonic_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density.harmonic_occupancy(components(spark, sf_dir)))


@query(rounded_sql(with_ctes(COMPONENTS) + "SELECT note, count(DISTINCT greatest(0, least(ceil(24 * log2(50.0)) - 1, floor(24 * log2(freq_hz / 100.0))))) / ceil(24 * log2(50.0)) AS occupancy FROM components WHERE comp = 'I' AND freq_hz BETWEEN 100 AND 5000 GROUP BY note", "occupancy"))
def residual_log_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density.log_frequency_occupancy(components(spark, sf_dir)))


@query(
    rounded_sql(
        with_ctes(
            COMPONENTS,
            "t AS (SELECT note, comp, amp * amp AS p, max(CASE WHEN comp = 'H' THEN amp * amp END) OVER (PARTITION BY note) AS top FROM components)",
            "k AS (SELECT note, CASE WHEN comp = 'H' AND p >= top * 0.0001 THEN 'strong' WHEN comp = 'H' THEN 'weak' ELSE 'rest' END AS kind, p FROM t)",
            "g AS (SELECT note, kind, sum(p) AS p, sum(p * p) AS pp FROM k GROUP BY note, kind)",
        )
        + "SELECT note, pow(sum(p), 2) / sum(CASE WHEN kind = 'strong' THEN pp ELSE p * p END) AS effective FROM g GROUP BY note",
        "effective",
    )
)
def pooled_component_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density.pooled_components(components(spark, sf_dir)))


@query(rounded_sql(with_ctes(SPECTRUM, "b AS (SELECT note, floor(freq_hz / 500) AS band, sum(amp) AS a FROM spectrum GROUP BY ALL)") + "SELECT note, count(*) FILTER (WHERE a > 0.5) AS occupied, avg(CASE WHEN a > 0.5 THEN 1.0 ELSE 0.0 END) AS share FROM b GROUP BY note", "share", "note occupied"))
def band_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density.band_occupancy(spectrum(spark, sf_dir)))


@query(
    rounded_sql(
        with_ctes(
            COMPONENTS,
            "t AS (SELECT note, n, max(amp * amp) AS p FROM components WHERE comp = 'H' GROUP BY note, n)",
            "x AS (SELECT note, greatest(0.0, least(1.0, (10 * log10(p / max(p) OVER (PARTITION BY note)) + 60) / 60)) AS x FROM t)",
        )
        + "SELECT note, sum(x) AS salience, count(*) FILTER (WHERE x > 0) AS salient FROM x GROUP BY note",
        "salience",
        "note salient",
    )
)
def harmonic_salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density.salience(components(spark, sf_dir)))


@query(rounded_sql(with_ctes(COMPONENTS) + "SELECT note, coalesce(sum(amp * amp) FILTER (WHERE n % 2 = 1), 0) / nullif(sum(amp * amp) FILTER (WHERE n % 2 = 0), 0) AS odd_even FROM components WHERE comp = 'H' GROUP BY note", "odd_even"))
def odd_even_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density.odd_even_ratio(components(spark, sf_dir)))


@query(
    rounded_sql(
        with_ctes(
            COMPONENTS,
            "b AS (SELECT note, freq_hz, amp, amp / (1 + (freq_hz / 1500) * (freq_hz / 1500)) AS b FROM components)",
            "t AS (SELECT *, max(b) OVER (PARTITION BY note) AS top FROM b)",
            "g AS (SELECT note, freq_hz, amp, CASE WHEN b >= top * pow(10, -2.5) THEN b END AS near FROM t)",
        )
        + f"SELECT note, {_NEFF.format('near')} AS body_density, sum(CASE WHEN freq_hz < 1000 THEN amp ELSE 0 END) / sum(amp) AS low_share FROM g GROUP BY note",
        "body_density low_share",
    )
)
def body_weighted_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density.body_weighted(components(spark, sf_dir)))


_SHARES = "h AS (SELECT note, amp * amp / sum(amp * amp) OVER (PARTITION BY note) AS p FROM components)"


@query(rounded_sql(with_ctes(COMPONENTS, _SHARES) + "SELECT note, CAST(count(*) FILTER (WHERE p > 0) AS DOUBLE) AS d0, exp(-sum(p * ln(p))) AS d1, 1 / sum(p * p) AS d2, 1 / max(p) AS dinf, 1 / sum(p * p) / count(*) AS evenness FROM h GROUP BY note", "d0 d1 d2 dinf evenness"))
def hill_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density.hill_profile(components(spark, sf_dir)))


@query(
    rounded_sql(
        with_ctes(COMPONENTS, _SHARES, "q AS (SELECT unnest([0.0, 0.5, 1.0, 1.5, 2.0, 3.0])::DOUBLE AS q)")
        + "SELECT note, q, CASE WHEN q = 1 THEN exp(-sum(p * ln(p))) WHEN q = 0 THEN count(*) ELSE pow(sum(pow(p, q)), 1 / (1 - q)) END AS d FROM h, q GROUP BY note, q",
        "q d",
    )
)
def hill_q_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density.hill_sweep(components(spark, sf_dir)))


_ERB = "21.4 * log10(1 + 0.00437 * freq_hz)"
_MERGED = f"m AS (SELECT note, comp, CAST(floor({_ERB}) AS BIGINT) AS cell, sqrt(sum(amp * amp)) AS amp, sum(amp * amp * freq_hz) / sum(amp * amp) AS freq_hz, count(*) AS merged FROM components GROUP BY ALL)"


@query(rounded_sql(with_ctes(COMPONENTS, _MERGED) + "SELECT * FROM m", "amp freq_hz", "note comp cell merged"))
def erb_grid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density.merge_erb_grid(components(spark, sf_dir)))


@query(
    rounded_sql(
        with_ctes(
            COMPONENTS,
            _MERGED,
            "p AS (SELECT note, comp, amp * amp AS e, amp * amp / sum(amp * amp) OVER (PARTITION BY note, comp) AS p FROM m)",
            "k AS (SELECT note, comp, exp(-sum(p * ln(p))) AS d1, 1 / sum(p * p) AS d2, sum(e) AS e FROM p GROUP BY note, comp)",
            "g AS (SELECT note, sum(e * d1) / sum(e) AS acd, sum(e * d2) / sum(e) AS acd_d2, sum(e) AS e, list(comp) AS have FROM k WHERE e > 0 GROUP BY note)",
        )
        + """SELECT note, acd, acd_d2, e / acd AS magnitude,
  CASE WHEN len(have) = 3 THEN 'ok' ELSE 'ok_with_unused:' || array_to_string(list_filter(['H', 'I', 'S'], lambda x: NOT list_contains(have, x)), ',') END AS status FROM g""",
        "acd acd_d2 magnitude",
        "note status",
    )
)
def acd_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density.component_density(dealt(spark, sf_dir, components(spark, sf_dir))))


@query(
    rounded_sql(
        with_ctes(
            COMPONENTS,
            "pool AS (SELECT note, amp FROM components WHERE status <> 'floor' AND ((comp = 'H' AND include) OR (comp = 'I' AND status = 'confirmed') OR (comp = 'S' AND freq_hz <= 2000)))",
            "s AS (SELECT note, amp * amp / sum(amp * amp) OVER (PARTITION BY note) AS p FROM pool)",
        )
        + "SELECT note, exp(-sum(p * ln(p))) AS d1, count(*) AS pooled FROM s GROUP BY note",
        "d1",
        "note pooled",
    )
)
def balanced_d1_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonagrid.operators.classify import balanced_pool

    pool = balanced_pool(components(spark, sf_dir))
    counts = density.hill_profile(pool).select("note", "d1", F.col("d0").cast("long").alias("pooled"))
    return rounded(counts)
