"""Queries of resolution, policy and corpus gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonagrid.functions import policy, resolution, scales
from sonagrid.operators import gates
from sonagrid.plans.catalog import query
from sonagrid.plans.inputs import COMPONENTS, METRICS, SPECTRUM, components, metrics, spectrum, table, with_ctes
from sonagrid.plans.rounding import rounded, rounded_sql

_NOTES = """notes AS (
  SELECT o_orderkey AS note, 30.0::DOUBLE + o_orderkey % 500 AS f0, CAST(1024 * CAST(pow(2, o_orderkey % 6) AS INTEGER) AS INTEGER) AS n_fft,
    CASE WHEN o_custkey % 3 = 0 THEN 48000 ELSE 44100 END AS rate, CASE WHEN o_custkey % 4 <> 0 THEN (o_custkey % 10) / 10.0::DOUBLE END AS seconds,
    CAST(o_custkey % 40 AS INTEGER) AS frames, CAST(o_custkey % 3000 AS INTEGER) AS hop, CAST(floor(o_totalprice) AS BIGINT) AS samples
  FROM orders)"""


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("note"),
        (30.0 + key % 500).alias("f0"),
        (1024 * F.pow(F.lit(2.0), key % 6).cast("int")).cast("int").alias("n_fft"),
        F.when(cust % 3 == 0, 48000).otherwise(44100).alias("rate"),
        F.when(cust % 4 != 0, (cust % 10) / 10.0).alias("seconds"),
        (cust % 40).cast("int").alias("frames"),
        (cust % 3000).cast("int").alias("hop"),
        F.col("o_totalprice").cast("long").alias("samples"),
    )


@query(
    rounded_sql(
        with_ctes(
            _NOTES,
            "r AS (SELECT *, rate / n_fft::DOUBLE AS bin, rate / n_fft::DOUBLE / f0 AS ratio, least(greatest(CAST(pow(2, ceil(log2(ceil(rate / (f0 * 0.125))))) AS INTEGER), n_fft), 32768) AS wanted FROM notes)",
            "g AS (SELECT *, ratio > 0.125 AND coalesce(wanted / rate::DOUBLE <= seconds, true) AND wanted > n_fft AS escalated FROM r)",
            "u AS (SELECT *, CASE WHEN escalated THEN wanted ELSE n_fft END AS used FROM g)",
        )
        + """SELECT note, used AS n_fft, rate / used::DOUBLE / f0 AS bin_to_f0, escalated, rate / used::DOUBLE / f0 > 0.125 AS warning, bin AS bin_hz,
  greatest(3, least(256, CAST(round_even(0.5 * f0 / bin, 0) AS INTEGER))) AS saddle_bins, 2 * bin AS leakage_hz, greatest(5.0, 2 * bin) AS protection_hz FROM u""",
        "bin_to_f0 bin_hz leakage_hz protection_hz",
        "note n_fft escalated warning saddle_bins",
    )
)
def resolution_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _notes(spark, sf_dir)
    f0, n_fft, rate = F.col("f0"), F.col("n_fft"), F.col("rate")
    width = resolution.bin_width(rate, n_fft)
    guard = {k: v.alias(k) for k, v in resolution.resolution_guard(f0, n_fft, rate, F.col("seconds")).items()}
    return rounded(rows.select("note", *guard.values(), width.alias("bin_hz"), resolution.saddle_bins(f0, width).alias("saddle_bins"), resolution.leakage_half_width(width).alias("leakage_hz"), resolution.protection_tolerance(width).alias("protection_hz")))


@query(
    rounded_sql(
        with_ctes(_NOTES)
        + """SELECT note, greatest(2.0, 3 * f0 * (pow(2.0::DOUBLE, 15 / 1200.0::DOUBLE) - 1)) AS tolerance_hz, frames * 0.01::DOUBLE AS false_slots,
  CAST(greatest(0, floor(5000 / f0) - greatest(1, ceil(100 / f0)) + 1) AS BIGINT) AS orders,
  CAST(ceil(1200 * log2(5000 / least(f0 / 2, 80.0)) / 25) AS BIGINT) AS log_bins,
  greatest(least(f0 / 2, 80.0), least(f0, 200.0)) AS diagnostic_hz,
  CASE WHEN f0 < 200 THEN 'low' WHEN f0 < 400 THEN 'mid' WHEN f0 < 800 THEN 'high' ELSE 'very_high' END AS register,
  CASE WHEN n_fft < 64 THEN 'n_fft under 64' WHEN n_fft > 65536 THEN 'n_fft over 65536' WHEN hop < 1 THEN 'no hop' WHEN hop > n_fft THEN 'hop over n_fft' WHEN samples < n_fft THEN 'shorter than n_fft' END AS problem FROM notes""",
        "tolerance_hz false_slots diagnostic_hz",
        "note orders log_bins register problem",
    )
)
def expected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f0 = F.col("f0")
    upper = scales.low_band_upper(f0)
    return rounded(
        _notes(spark, sf_dir).select(
            "note",
            resolution.perceptual_tolerance(f0, F.lit(3)).alias("tolerance_hz"),
            resolution.false_slots(F.col("frames"), 0.01).alias("false_slots"),
            resolution.expected_orders(f0, 100.0, 5000.0).alias("orders"),
            resolution.expected_log_bins(upper, 5000.0, 25.0).alias("log_bins"),
            resolution.diagnostic_upper(f0, upper).alias("diagnostic_hz"),
            resolution.register_by_frequency(f0).alias("register"),
            resolution.audio_problem(F.col("n_fft"), F.col("hop"), F.col("rate"), F.col("samples")).alias("problem"),
        )
    )


@query(
    rounded_sql(
        with_ctes(
            _NOTES,
            "s AS (SELECT *, greatest(hop, 1) AS h, CASE WHEN note % 5 <> 0 THEN samples % 4000 END AS a, samples % 9000 AS b FROM notes)",
            "f AS (SELECT *, coalesce(b > a, false) AND frames > 0 AS valid, greatest(0, least(frames, CAST(round_even(a / h::DOUBLE, 0) AS INTEGER))) AS a_, least(frames, CAST(round_even(b / h::DOUBLE, 0) AS INTEGER)) AS b_ FROM s)",
        )
        + "SELECT note, CASE WHEN valid THEN a_ ELSE 0 END AS first_frame, CASE WHEN valid THEN greatest(a_ + 1, b_) ELSE frames END AS last_frame, n_fft / h::DOUBLE AS overlap, h / rate::DOUBLE AS hop_s FROM f",
        "overlap hop_s",
        "note first_frame last_frame",
    )
)
def frame_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _notes(spark, sf_dir).withColumn("h", F.greatest(F.col("hop"), F.lit(1)))
    first, last = resolution.frame_span(F.col("frames"), F.col("h"), F.when(F.col("note") % 5 != 0, F.col("samples") % 4000), F.col("samples") % 9000)
    return rounded(rows.select("note", first.alias("first_frame"), last.alias("last_frame"), resolution.overlap(F.col("n_fft"), F.col("h")).alias("overlap"), resolution.hop_seconds(F.col("h"), F.col("rate")).alias("hop_s")))


@query(
    rounded_sql(
        with_ctes(COMPONENTS)
        + "SELECT note, n, comp, greatest(0.0, amp - CASE WHEN n % 2 = 0 THEN amp / pow(10, persistence * 100 / 20) WHEN n % 3 = 0 THEN 0.3 ELSE 0 END) AS mass FROM components",
        "mass",
        "note n comp",
    )
)
def gated_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amplitude above the floor, from a signal-to-noise ratio, a floor, or neither."""
    n = F.col("n")
    return rounded(components(spark, sf_dir).select("note", "n", "comp", resolution.gated_mass(F.col("amp"), F.when(n % 2 == 0, F.col("persistence") * 100), F.when(n % 3 == 0, 0.3)).alias("mass")))


@query(
    rounded_sql(
        with_ctes(SPECTRUM, "d AS (SELECT note, freq_hz, lead(freq_hz) OVER (PARTITION BY note ORDER BY freq_hz) - freq_hz AS d FROM spectrum)")
        + "SELECT note, quantile_cont(d, 0.5) FILTER (WHERE d > 0) AS step_hz, count(*) >= 8 AND abs(quantile_cont(d, 0.5) FILTER (WHERE d > 0) - 44100 / 512.0) <= 0.35 * 44100 / 512.0 AS regular FROM d GROUP BY note",
        "step_hz",
        "note regular",
    )
)
def grid_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gates.grid_step(spectrum(spark, sf_dir), 44100.0, 512))


@query(
    rounded_sql(
        with_ctes(COMPONENTS, "e AS (SELECT note, greatest(100.0, freq_hz - 75) AS lo, least(4000.0, freq_hz + 75) AS hi FROM components WHERE comp = 'H' AND include)", "i AS (SELECT * FROM e WHERE hi > lo)", "b AS (SELECT *, max(hi) OVER (PARTITION BY note ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM i)", "p AS (SELECT note, sum(greatest(0.0, hi - greatest(lo, coalesce(before, lo)))) AS excluded FROM b GROUP BY note)")
        + "SELECT note, 3900 - coalesce(excluded, 0) AS residual_hz, coalesce(excluded, 0) AS excluded_hz FROM (SELECT DISTINCT note FROM components) LEFT JOIN p USING (note)",
        "residual_hz excluded_hz",
    )
)
def band_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = components(spark, sf_dir)
    return rounded(gates.band_regions(rows.select("note").distinct(), rows.filter((F.col("comp") == "H") & F.col("include")), 100.0, 4000.0, 150.0))


_RATIOS = """r AS (
  SELECT o_orderkey AS note, CASE WHEN o_custkey % 3 = 0 THEN 0.5::DOUBLE END AS a_h, 0.3::DOUBLE AS a_i, 0.2::DOUBLE AS a_s,
    CASE WHEN o_custkey % 2 = 0 THEN (o_orderkey % 7) / 10.0::DOUBLE END AS b_h, 0.25::DOUBLE AS b_i, CASE WHEN o_custkey % 5 = 0 THEN -0.1::DOUBLE ELSE 0.05::DOUBLE END AS b_s
  FROM orders)"""


@query(
    rounded_sql(
        with_ctes(_RATIOS, "c AS (SELECT *, CASE WHEN a_h >= 0 AND a_i >= 0 AND a_s >= 0 AND a_h + a_i + a_s > 0 THEN 'exact' WHEN b_h >= 0 AND b_i >= 0 AND b_s >= 0 AND b_h + b_i + b_s > 0 THEN 'energy' ELSE 'missing' END AS source, CASE WHEN a_h >= 0 THEN a_h ELSE b_h END AS h, CASE WHEN a_h >= 0 THEN a_i ELSE b_i END AS i, CASE WHEN a_h >= 0 THEN a_s ELSE b_s END AS s FROM r)", "t AS (SELECT note, source, CASE WHEN source <> 'missing' THEN h END AS h, CASE WHEN source <> 'missing' THEN i END AS i, CASE WHEN source <> 'missing' THEN s END AS s FROM c)", "w AS (SELECT *, h + i + s AS input_sum, coalesce(abs(h + i + s - 1) > 0.001, false) AS normalised FROM t)")
        + "SELECT note, source, CASE WHEN normalised THEN h / input_sum ELSE h END AS h, CASE WHEN normalised THEN i / input_sum ELSE i END AS i, CASE WHEN normalised THEN s / input_sum ELSE s END AS s, input_sum, normalised, coalesce(abs(h + i + s - 1) <= 0.001, false) AS valid FROM w",
        "h i s input_sum",
        "note source normalised valid",
    )
)
def ratio_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    sources = {
        "exact": [F.when(cust % 3 == 0, 0.5), F.lit(0.3), F.lit(0.2)],
        "energy": [F.when(cust % 2 == 0, (key % 7) / 10.0), F.lit(0.25), F.when(cust % 5 == 0, -0.1).otherwise(0.05)],
    }
    rows = table(spark, sf_dir, "orders").select(key.alias("note"), policy.chosen_ratios(sources).alias("r"))
    raw = [F.when(F.col("r.normalised"), F.col(f"r.{c}") * F.col("r.input_sum")).otherwise(F.col(f"r.{c}")) for c in "his"]
    return rounded(rows.select("note", "r.*", policy.ratios_valid(raw).alias("valid")))


@query(
    rounded_sql(
        with_ctes(METRICS, "s AS (SELECT note, m1 AS a, m3 AS b, m2 AS c, m1 * 2 AS d FROM metrics)")
        + "SELECT note, CASE WHEN abs(b) > 1e-30 THEN a / b END AS ratio, CASE WHEN c IS NOT NULL AND least(c, d) > 1e-30 THEN greatest(c, d) / least(c, d) END AS centroid_ratio, coalesce(a / b > 1.3, false) OR coalesce(greatest(c, d) / least(c, d) > 2 AND c IS NOT NULL, false) AS unrepresentative FROM s",
        "ratio centroid_ratio",
        "note unrepresentative",
    )
)
def stable_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = policy.stable_segment_flags(F.col("m1"), F.col("m3"), F.col("m2"), F.col("m1") * 2)
    return rounded(metrics(spark, sf_dir).select("note", *[v.alias(k) for k, v in flags.items()]))


@query(
    "SELECT o_orderkey AS note, lower(o_orderpriority) = '1-urgent' AND o_orderstatus = 'F' AS comparable, regexp_matches(lower(o_orderpriority), '^(1|1_.*)$') AS in_family, substr(sha256(CAST(o_custkey AS VARCHAR)), 1, 12) AS digest, CAST(('0x' || substr(sha256(CAST(o_custkey AS VARCHAR)), 1, 8))::BIGINT % 2147483648 AS BIGINT) AS seed, CASE WHEN regexp_matches(lower(o_orderpriority), 'urgent') THEN 'first' WHEN regexp_matches(lower(o_orderpriority), 'not specified') THEN 'open' END AS matched FROM orders"
)
def profile_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.col("o_orderpriority")
    digest = F.sha2(F.col("o_custkey").cast("string"), 256)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("note"),
        policy.comparable_profile(priority, F.when(F.col("o_orderstatus") == "F", "fixed").otherwise("free"), "1-urgent").alias("comparable"),
        policy.in_family(priority, "1").alias("in_family"),
        policy.short_digest(F.col("o_custkey")).alias("digest"),
        policy.seed_from_digest(digest).alias("seed"),
        policy.matched_terms(priority, {"first": ("urgent",), "open": ("not specified",)}).alias("matched"),
    )


@query(
    rounded_sql(
        with_ctes(COMPONENTS)
        + "SELECT note, sqrt(sum(amp * amp) FILTER (WHERE comp = 'S')) AS amplitude, sum(amp) FILTER (WHERE comp = 'S') AS mass, avg(freq_hz) FILTER (WHERE comp = 'S') AS mean_hz, coalesce(sum(amp * amp) FILTER (WHERE comp = 'S' AND freq_hz <= 2000), 0) AS gated_energy, count(*) FILTER (WHERE status = 'floor') AS floor_rows, sum(amp * amp * persistence * 100) FILTER (WHERE comp = 'H' AND include) / sum(amp * amp) FILTER (WHERE comp = 'H' AND include) AS snr_db FROM components GROUP BY note",
        "amplitude mass mean_hz gated_energy snr_db",
        "note floor_rows",
    )
)
def low_band_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = components(spark, sf_dir).withColumn("member", (F.col("comp") == "S") & (F.col("freq_hz") <= 2000)).withColumn("snr_db", F.col("persistence") * 100)
    return rounded(gates.low_band_aggregates(rows))


@query(
    with_ctes(
        COMPONENTS,
        "c AS (SELECT note, count(*) AS slots, count(*) FILTER (WHERE include) AS accepted, count(*) FILTER (WHERE include AND n > 3) AS above, count(*) FILTER (WHERE status = 'candidate') AS marginal, count(*) FILTER (WHERE include AND status = 'floor') AS weak FROM components GROUP BY note)",
    )
    + "SELECT note, accepted, above, accepted > 3 + slots * 0.1 AS suspect, marginal, weak, accepted - weak AS strict FROM c"
)
def high_order_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders 1 to 3 are the body here; marginal rows are candidates, weak ones those on the floor."""
    return gates.high_order_guards(components(spark, sf_dir).withColumn("stop", F.lit(3)), 0.1, "candidate", "floor")


@query(
    rounded_sql(
        with_ctes(METRICS)
        + """SELECT check_name, violations, rows_checked, CASE WHEN violations = 0 THEN 'ok' WHEN violations < rows_checked THEN 'degraded' ELSE 'failed' END AS status FROM (
  SELECT 'm1 positive' AS check_name, count(*) FILTER (WHERE NOT coalesce(m1 > 0, false)) AS violations, count(*) AS rows_checked FROM metrics
  UNION ALL SELECT 'm2 present', count(*) FILTER (WHERE m2 IS NULL), count(*) FROM metrics
  UNION ALL SELECT 'm4 negative', count(*) FILTER (WHERE NOT coalesce(m4 < 0, false)), count(*) FROM metrics)""",
        "",
        "check_name violations rows_checked status",
    )
)
def corpus_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {"m1 positive": F.col("m1") > 0, "m2 present": F.col("m2").isNotNull(), "m4 negative": F.col("m4") < 0}
    return gates.policy_report(metrics(spark, sf_dir), checks)


@query(
    with_ctes(METRICS, "p AS (SELECT coalesce(grp, 'none') AS grp, CAST(floor(m1 / 100) AS BIGINT) AS profile FROM metrics)")
    + "SELECT grp, count(DISTINCT profile) AS profiles, count(DISTINCT profile) > 1 AS mixed FROM p GROUP BY grp"
)
def mixed_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics(spark, sf_dir).select(F.coalesce("grp", F.lit("none")).alias("grp"), F.floor(F.col("m1") / 100).alias("profile"))
    return gates.mixed_profiles(rows, ["grp"], "profile")


@query(
    with_ctes(
        COMPONENTS,
        "r AS (SELECT note, n, comp, status FROM components WHERE status = 'floor')",
    )
    + "SELECT note, count(*) AS rejected, string_agg(comp || CAST(n AS VARCHAR), ',' ORDER BY n, comp) AS what FROM r GROUP BY note"
)
def floor_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected rows of each note in one text."""
    return gates.rejections(components(spark, sf_dir).filter("status = 'floor'"), F.concat("comp", F.col("n").cast("string")), ["n", "comp"]).select("note", "rejected", F.array_join("what", ",").alias("what"))
