"""Queries of scalar functions: pitch, text, levels, tolerances, guards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonagrid.functions import guards, notes, phi, publication, scales
from sonagrid.plans.catalog import query
from sonagrid.plans.inputs import COMPONENTS, components, table, with_ctes
from sonagrid.plans.rounding import rounded, rounded_sql

_NAMES = "['C', 'C#', 'D', 'Eb', 'E', 'F', 'F#', 'G', 'Ab', 'A', 'Bb', 'B']"
_PITCH = f"p AS (SELECT o_orderkey AS note, {_NAMES}[1 + o_orderkey % 12] || CAST(1 + o_custkey % 7 AS VARCHAR) AS token FROM orders)"


@query(
    rounded_sql(
        with_ctes(
            _PITCH,
            "m AS (SELECT note, token, CAST(12 * (CAST(right(token, 1) AS INTEGER) + 1) + list_position(['C', '', 'D', '', 'E', 'F', '', 'G', '', 'A', '', 'B'], left(token, 1)) - 1 + CASE WHEN token LIKE '_#%' THEN 1 WHEN token LIKE '_b%' THEN -1 ELSE 0 END AS INTEGER) AS midi FROM p)",
        )
        + "SELECT note, token, midi, midi % 12 AS pitch_class, 440 * pow(2, (midi - 69) / 12.0) AS frequency, CASE WHEN midi < 48 THEN 'low' WHEN midi < 60 THEN 'mid_low' WHEN midi < 72 THEN 'mid' WHEN midi < 84 THEN 'mid_high' ELSE 'high' END AS register FROM m",
        "frequency",
        "note token midi pitch_class register",
    )
)
def note_parse_midi(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("C", "C#", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B")])
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("note"), F.concat(F.lit("flute_"), F.get(names, F.pmod("o_orderkey", F.lit(12)).cast("int")), (1 + F.pmod("o_custkey", F.lit(7))).cast("string"), F.lit("_mf.wav")).alias("file"))
    rows = rows.withColumn("token", notes.note_token(F.col("file")))
    m = notes.midi(F.col("token"))
    return rounded(rows.select("note", "token", m.alias("midi"), notes.pitch_class(F.col("token")).alias("pitch_class"), notes.midi_frequency(m).alias("frequency"), notes.register(m).alias("register")))


@query(with_ctes(_PITCH) + "SELECT note, token, CAST(row_number() OVER (PARTITION BY note % 10 ORDER BY CAST(right(token, 1) AS INTEGER), list_position(['C', 'D', 'E', 'F', 'G', 'A', 'B'], left(token, 1)), token, note) AS INTEGER) AS place FROM p")
def chromatic_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of notes ordered by octave, letter, name and row, within ten groups."""
    from pyspark.sql import Window

    names = F.array(*[F.lit(x) for x in ("C", "C#", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B")])
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("note"), F.concat(F.get(names, F.pmod("o_orderkey", F.lit(12)).cast("int")), (1 + F.pmod("o_custkey", F.lit(7))).cast("string")).alias("token"))
    letters = F.create_map(*[F.lit(x) for i, c in enumerate("CDEFGAB") for x in (c, i)])
    order = Window.partitionBy(F.pmod("note", F.lit(10))).orderBy(notes.octave(F.col("token")).asc_nulls_last(), F.try_element_at(letters, F.substring("token", 1, 1)), "token", "note")
    return rows.select("note", "token", F.row_number().over(order).alias("place"))


_PATHS = r"t AS (SELECT page_id, 'see /home/user' || page_id || '/take.wav and ' || url || ' or C:\work\x' AS text FROM pages)"


@query(with_ctes(_PATHS) + r"SELECT page_id, 'see [path] and ' || url || ' or [path]' AS text, true AS had_path FROM t JOIN pages USING (page_id)")
def path_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("see /home/user"), F.col("page_id").cast("string"), F.lit("/take.wav and "), "url", F.lit(" or C:\\work\\x")).alias("text"))
    out = publication.redact_all(rows.withColumn("had_path", publication.has_local_path(F.col("text"))))
    return out.select("page_id", "text", "had_path")


@query("SELECT c_custkey, 'wf=' || lower(c_mktsegment) || CASE WHEN c_nationkey % 2 = 0 THEN '|nation=' || c_nationkey ELSE '' END AS profile, lower(c_mktsegment) AS wf, CASE WHEN c_nationkey % 2 = 0 THEN CAST(c_nationkey AS VARCHAR) END AS nation FROM customer")
def profile_id_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    profile = publication.profile_id({"wf": F.lower("c_mktsegment"), "nation": F.when(F.pmod("c_nationkey", F.lit(2)) == 0, F.col("c_nationkey"))})
    parsed = publication.parse_profile(F.col("profile"))
    return rows.select("c_custkey", profile.alias("profile")).select("c_custkey", "profile", F.try_element_at(parsed, F.lit("wf")).alias("wf"), F.try_element_at(parsed, F.lit("nation")).alias("nation"))


@query("SELECT s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-') || '__' || left(sha256('A4|' || s_name || '|' || s_suppkey), 12) AS sample_id FROM supplier")
def sample_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", publication.sample_id(F.lit("A4"), F.col("s_name"), F.col("s_suppkey")).alias("sample_id"))


@query("SELECT p_partkey, list_distinct(string_split(p_name || ' ' || lower(p_type), ' '))::VARCHAR[] IS NOT NULL AS ok, array_to_string(string_split(p_name, ' '), '+') AS tokens, len(string_split(p_name, ' ')) AS n FROM part")
def metadata_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = publication.tokens(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", t.isNotNull().alias("ok"), F.array_join(t, "+").alias("tokens"), F.size(t).cast("long").alias("n"))


@query(
    rounded_sql(
        with_ctes(COMPONENTS)
        + """SELECT note, n, part, bin, 20 * log10(greatest(amp, 1e-12)) AS db, 1200 * log2(peak_hz / (f0_hz * n)) AS cents, 0.108 * freq_hz + 24.7 AS erb, 21.4 * log10(1 + 0.00437 * freq_hz) AS erb_rate,
  25 + 75 * pow(1 + 1.4 * (freq_hz / 1000) * (freq_hz / 1000), 0.69) AS zwicker, 13 * atan(0.00076 * freq_hz) + 3.5 * atan((freq_hz / 7500) * (freq_hz / 7500)) AS bark,
  n * f0_hz * sqrt(1 + 0.0001 * n * n) AS stretched, least(0.5 * f0_hz, 80) AS low_upper, 69 + 12 * log2(freq_hz / 440) AS midi FROM components""",
        "db cents erb erb_rate zwicker bark stretched low_upper midi",
        "note n part bin",
    )
)
def scale_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, n, f0 = F.col("freq_hz"), F.col("n"), F.col("f0_hz")
    return rounded(
        components(spark, sf_dir).select(
            "note", "n", "part", "bin", scales.amplitude_to_db(F.col("amp")).alias("db"), scales.cents(F.col("peak_hz") / (f0 * n)).alias("cents"), scales.erb_bandwidth(f).alias("erb"), scales.erb_rate(f).alias("erb_rate"),
            scales.zwicker_bandwidth(f).alias("zwicker"), scales.bark(f).alias("bark"), scales.stretched(n, f0, F.lit(0.0001)).alias("stretched"), scales.low_band_upper(f0).alias("low_upper"), notes.frequency_midi(f).alias("midi"),
        )
    )


@query(
    rounded_sql(
        "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_discount > 0 THEN l_tax / l_discount END AS ratio, CASE WHEN l_discount <> 0 THEN 100 * (l_tax - l_discount) / abs(l_discount) END AS delta, pow(greatest(0, least(1, l_tax * 20)), 0.5) AS powered, abs(l_tax - l_discount) / nullif(greatest(abs(l_tax), abs(l_discount)), 0) AS step, coalesce(l_tax BETWEEN 0.01 AND 0.05, false) AS inside FROM lineitem",
        "ratio delta powered step",
        "l_orderkey l_partkey l_suppkey l_linenumber inside",
    )
)
def guarded_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("l_tax"), F.col("l_discount")
    return rounded(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", guards.ratio(a, b).alias("ratio"), guards.relative_delta_percent(a, b).alias("delta"), guards.power01(a * 20, 0.5).alias("powered"), guards.step_ratio(b, a).alias("step"), guards.in_range(a, 0.01, 0.05).alias("inside")))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS number, CAST(json_extract_string(props, '$.k') AS BIGINT) AS whole, event_type IN ('true', 'yes') AS flag FROM events")
def coerced_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", guards.number(k).alias("number"), guards.whole(k).alias("whole"), guards.flag(F.col("event_type")).alias("flag"))


@query(
    rounded_sql(
        "SELECT k, factor, name FROM (SELECT p_partkey AS k, CASE p_size % 3 WHEN 0 THEN 4096.0 / (1024 * (1 + p_size % 8)) WHEN 1 THEN pow(4096.0 / (1024 * (1 + p_size % 8)), 2) ELSE 1.0 END AS factor, CASE p_size % 4 WHEN 0 THEN 'linear' WHEN 1 THEN 'd17' WHEN 2 THEN 'log' END AS name FROM part) AS x",
        "factor",
        "k name",
    )
)
def tier_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("p_size")
    kind = F.when(s % 3 == 0, "peak_amplitude_sum").when(s % 3 == 1, "peak_power_sum").otherwise("other")
    given = F.when(s % 4 == 0, " SUM ").when(s % 4 == 1, "d8").when(s % 4 == 2, "Log1p").otherwise("nothing")
    return rounded(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), scales.tier_factor(1024 * (1 + s % 8), kind).alias("factor"), phi.canonical_name_column(given).alias("name")))
