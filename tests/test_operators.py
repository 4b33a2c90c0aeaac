"""Operators against brute force, planted truth and edge cases."""

from __future__ import annotations

import io
import math
import tracemalloc
import wave

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sonagrid.functions import guards, notes, phi, publication, scales
from statistics import NormalDist

from sonagrid.functions import resolution
from sonagrid.operators import adaptive, classify, confirmation, density, dissonance, normalise, persistence, ranges, relational, signal, statistics, uncertainty
from sonagrid.sources import audio, sheets
from sonagrid.streaming import profiles

COMPONENT = "note long, comp string, amp double, freq_hz double, include boolean, status string"


def parts(spark, rows):
    return spark.createDataFrame([(n, c, float(a), float(f), True, "confirmed") for n, c, a, f in rows], COMPONENT)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_three_compartments_by_hand(spark):
    rows = [(1, "H", 1.0, 100), (1, "H", 0.5, 200), (1, "I", 0.25, 130), (1, "S", 0.1, 40)]
    energy = {"H": 1.25, "I": 0.0625, "S": 0.01}
    total = sum(energy.values())
    strict = balanced = 0.0
    for c in "HIS":
        s = [math.log1p(a) for _, k, a, _ in rows if k == c]
        penalty = sum(s) ** 2 / sum(x * x for x in s) / len(s)
        strict += energy[c] / total * sum(s) * penalty
        balanced += energy[c] / total * sum(s) * penalty**0.5
    got = one(density.note_scores(parts(spark, rows)))
    assert got.strict == pytest.approx(strict, rel=1e-12)
    assert got.balanced == pytest.approx(balanced, rel=1e-12)


@pytest.mark.parametrize("k", [1, 2, 4, 8, 16])
def test_equal_well_separated_components_count_k(spark, k):
    rows = parts(spark, [(1, "H", 0.3, 200.0 * (i + 1)) for i in range(k)])
    got = one(density.hill_profile(density.merge_erb_grid(rows, 0.1)))
    assert (got.d0, got.d1, got.d2, got.dinf) == pytest.approx((k, k, k, k))
    assert one(density.component_density(rows, 0.1)).status == "ok_with_unused:I,S"


def test_components_within_one_erb_merge(spark):
    rows = parts(spark, [(1, "H", 0.3, 1000.0 + 0.1 * i) for i in range(16)])
    assert density.merge_erb_grid(rows).count() == 1


def test_empty_tables(spark):
    none = parts(spark, [])
    for out in (density.note_scores(none), density.hill_profile(none), density.component_density(none), dissonance.dissonance(none)):
        assert out.count() == 0


def test_phi_names():
    assert phi.canonical_name(" SUM ") == "linear" and phi.canonical_name("d8") == "d17"
    with pytest.raises(ValueError):
        phi.canonical_name("nothing")


def test_phi_of_negative_and_missing(spark):
    df = spark.createDataFrame([(-1.0,), (None,), (0.0,)], "a double").select(phi.phi("log", F.col("a")).alias("x"))
    assert [r.x for r in df.collect()] == [0.0, None, 0.0]


def test_roughness_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    f, a = rng.uniform(50, 8000, 300), rng.uniform(0, 1, 300)
    df = spark.createDataFrame([(1, float(x), float(y), i) for i, (x, y) in enumerate(zip(f, a, strict=True))], "note long, freq_hz double, amp double, id long")
    want = 0.0
    order = np.argsort(f)
    for i, p in enumerate(order):
        for q in order[i + 1 :]:
            x = (f[q] - f[p]) / (0.25 * (25 + 75 * (1 + 1.4 * (f[p] / 1000) ** 2) ** 0.69))
            if 0 < x <= 20:
                want += a[p] * a[q] * x * math.exp(1 - x)
    assert one(dissonance.roughness(df)).roughness == pytest.approx(want, rel=1e-6)


def test_roughness_width_holds_at_both_ends(spark):
    for basis, (_, scale, width) in dissonance._SCALES.items():
        bound = dissonance.reach_width(basis, 15500.0, 5.0)
        for f in np.concatenate([np.linspace(0, 300, 301), np.linspace(300, 15500, 3001)]):
            assert scale(min(f + 5 * width(f), 15500.0)) - scale(f) <= bound


def test_dissonance_of_200_partials_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    f, a = rng.uniform(50, 9000, 200), rng.uniform(0, 1, 200)
    df = spark.createDataFrame([(1, float(x), float(y)) for x, y in zip(f, a, strict=True)], "note long, freq_hz double, amp double")
    p, q = np.triu_indices(200, 1)
    low, high, least = np.minimum(f[p], f[q]), np.maximum(f[p], f[q]), np.minimum(a[p], a[q])
    y = 0.24 * (high - low) / (0.0207 * low + 18.96)
    want = (least * (np.exp(-3.5 * y) - np.exp(-5.75 * y))).sum()
    got = one(dissonance.dissonance(df))
    assert got.pairs == 19900 and got.sethares_sum == pytest.approx(want)
    assert got.sethares_minamp == pytest.approx(want / least.sum(), rel=1e-6)


def test_cfar_trains_on_64_bins_a_side(spark):
    amp = np.random.default_rng(4).uniform(0, 1, 150)
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(amp)], "note long, bin long, amp double")
    got = {r.bin: r.threshold for r in persistence.cfar(df).collect()}
    p = amp * amp
    for i in range(150):
        cells = np.sort(np.concatenate([p[max(0, i - 66) : max(0, i - 2)], p[i + 3 : i + 67]]))
        cells = cells[: int(len(cells) * 0.75)]
        assert got[i] == pytest.approx(len(cells) * (0.01 ** (-1 / len(cells)) - 1) * cells.mean())


def test_bootstrap_takes_1200_draws(spark):
    amp = np.random.default_rng(5).uniform(0, 1, 12)
    df = spark.createDataFrame([(1, float(x)) for x in amp], "note long, amp double")
    got = one(uncertainty.bootstrap_effective(df))
    assert got == one(uncertainty.bootstrap_effective(df, draws=1200))
    assert (got.low, got.high) != one(uncertainty.bootstrap_effective(df, draws=100))[3:5]
    assert got.low < got.estimate < got.high


def test_curve_takes_all_partials_at_100_intervals(spark):
    rng = np.random.default_rng(6)
    f, a = rng.uniform(100, 2000, 12), rng.uniform(0.1, 1, 12)
    df = spark.createDataFrame([(1, float(x), float(y)) for x, y in zip(f, a, strict=True)], "note long, freq_hz double, amp double")
    got = {r.step: r.dissonance for r in dissonance.curve(df).collect()}
    assert sorted(got) == list(range(100))
    for step in (0, 1, 50, 99):
        g = f * (1 + step / 99)
        low, high = np.minimum(f[:, None], g), np.maximum(f[:, None], g)
        y = 0.24 * (high - low) / (0.0207 * low + 18.96)
        want = (np.minimum(a[:, None], a) * (np.exp(-3.5 * y) - np.exp(-5.75 * y))).sum()
        assert got[step] == pytest.approx(want)


def test_band_pairs_meet_once(spark):
    rng = np.random.default_rng(2)
    v = [round(float(x), 1) for x in rng.uniform(0, 20, 60)]
    df = spark.createDataFrame([(1, x, i) for i, x in enumerate(v)], "g long, v double, id long")
    got = ranges.band_pairs(df, ["g"], "v", 1.5, ["v", "id"]).count()
    assert got == sum(abs(v[i] - v[j]) <= 1.5 + 1e-12 for i in range(60) for j in range(i))


def test_interval_union(spark):
    df = spark.createDataFrame([(1, 0.0, 2.0), (1, 1.0, 3.0), (1, 5.0, 6.0), (2, 0.0, 0.0)], "g long, lo double, hi double")
    got = {r.g: (r.covered, r.parts) for r in ranges.covered_length(df, ["g"], "lo", "hi").collect()}
    assert got == {1: (4.0, 2), 2: (0.0, 1)}


def test_exclusive_assignment_uses_each_bin_and_slot_once(spark):
    rows = [(1, 100.0, 100.5, 0.9, 7, 1, 0.0), (1, 100.0, 101.0, 0.5, 7, 2, 0.0), (1, 100.0, 99.0, 0.4, 8, 3, 0.0), (1, 100.0, 250.0, 0.8, 9, 4, 0.0)]
    df = spark.createDataFrame(rows, "note long, f0_hz double, peak_hz double, amp double, bin long, part long, persistence double")
    got = {r.part: r.assignment for r in classify.exclusive_assignment(classify.harmonic_slots(df)).collect()}
    assert got == {1: "assigned", 2: "peak_bin_taken", 3: "slot_taken", 4: "rejected_by_tolerance"}


def test_stretch_fit_recovers_stiffness(spark):
    rows = [(1, 100.0, n * 100.0 * math.sqrt(1 + 2e-4 * n * n), 1.0 / n, n, n, 0.0) for n in range(1, 9)]
    df = spark.createDataFrame(rows, "note long, f0_hz double, peak_hz double, amp double, bin long, part long, persistence double")
    got = one(classify.stretch_fit(classify.harmonic_slots(df, tolerance_cents=100)))
    assert got.b == pytest.approx(2e-4, rel=1e-6) and got.f0_fit == pytest.approx(100, rel=1e-6)


def test_merge_keeps_rows_and_fills_blanks(spark):
    left = spark.createDataFrame([("a", None), ("b", 2.0), ("c", None)], "note string, x double")
    right = spark.createDataFrame([("a", 1.0, 9), ("b", 5.0, 8)], "note string, x double, y int")
    got = {r.note: (r.x, r.y) for r in relational.merge_coalesce(left, right, ["note"]).collect()}
    assert got == {"a": (1.0, 9), "b": (2.0, 8), "c": (None, None)}
    with pytest.raises(ValueError):
        relational.require_unique(right.union(right), ["note"])


def test_merge_key_falls_back(spark):
    left = spark.createDataFrame([("s1", "A4"), ("s2", "A4")], "sample_id string, note string")
    assert relational.merge_keys(left, left, "sample_id", "note") == ["sample_id"]
    assert relational.merge_keys(left, left.drop("sample_id"), "sample_id", "note") == ["note"]
    assert relational.merge_keys(left, left.limit(1), "sample_id", "note") == ["note"]


def test_dead_and_equal_columns_go(spark):
    df = spark.createDataFrame([(1, None, "", 0, 1), (2, None, " ", 0, 2)], "a int, b double, c string, z int, a_2 int")
    assert relational.drop_dead_columns(df).columns == ["a", "z", "a_2"]
    assert "a_2" not in relational.drop_equal_columns(df).columns


def test_enforce_raises(spark):
    bad = relational.contract_violations(spark.createDataFrame([(None,), (1.0,)], "x double"), {"there": F.col("x") > 0})
    with pytest.raises(ValueError, match="there"):
        relational.enforce(bad)


def test_average_ranks(spark):
    df = spark.createDataFrame([(x,) for x in (3.0, 1.0, 3.0, 2.0)], "v double")
    assert sorted((r.v, r["rank"]) for r in normalise.average_ranks(df, [], "v").collect()) == [(1.0, 1.0), (2.0, 2.0), (3.0, 3.5), (3.0, 3.5)]


def test_constant_columns_have_no_scale(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0)], "note int, v double")
    assert {r.scaled for r in normalise.min_max(df, "v").collect()} == {None}
    assert {r.robust_z for r in normalise.robust_z(df, "v").collect()} == {None}
    assert one(statistics.correlations(df.withColumn("w", F.col("note") * 1.0), ["v", "w"])).r is None


def test_adaptive_fold_equals_steps(spark):
    rows = [("k", i, 0.5, 0.3, 0.2, 1.0 + i) for i in range(6)]
    got = one(adaptive.fold(spark.createDataFrame(rows, "k string, t int, o1 double, o2 double, o3 double, evidence double"), "k", ["t"]))
    alpha = (adaptive.START,) * 3
    for r in rows:
        alpha = profiles.step(alpha, r[2:5], r[5])
    assert (got.a1, got.a2, got.a3) == pytest.approx(alpha)


@given(st.lists(st.floats(0.01, 1.0), min_size=1, max_size=12))
@settings(max_examples=50, deadline=None)
def test_moving_centroid_keeps_energy(amps):
    merged = signal.moving_centroid_merge(np.linspace(100, 2000, len(amps)), np.array(amps))
    assert sum(a * a for _, a in merged) == pytest.approx(sum(a * a for a in amps))


def tone(f0: float, seconds: float = 0.5, rate: int = 8000) -> np.ndarray:
    t = np.arange(int(seconds * rate)) / rate
    return sum(np.sin(2 * np.pi * n * f0 * t) / n for n in range(1, 6)) / 3


@pytest.mark.parametrize("f0", [110.0, 220.0, 441.0])
def test_fundamental_of_a_tone(f0):
    assert signal.autocorrelation_f0(tone(f0), 8000.0) == pytest.approx(f0, rel=5e-3)


def test_silence():
    assert signal.autocorrelation_f0(np.zeros(100), 8000.0) is None
    assert signal.attack_sustain_release(np.zeros(10), 100.0) == (0.0, 0.0, 0.0)
    assert len(signal.trim_silence(np.zeros(10), 0.1, 2)) == 0


def test_spectrum_peaks_at_the_tone():
    p = signal.power_spectrum(np.sin(2 * np.pi * 1000 * np.arange(4096) / 8000), 512, 128)
    assert np.argmax(p) == 64


def test_smoothing_keeps_parabolas():
    x = np.arange(20.0) ** 2
    assert signal.savitzky_golay(x)[4:-4] == pytest.approx(x[4:-4])


def wav(samples: np.ndarray, rate: int = 8000) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((samples * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_audio_rows_and_broken_files(spark, tmp_path):
    (tmp_path / "A4.wav").write_bytes(wav(tone(440.0)))
    (tmp_path / "bad.wav").write_bytes(b"nothing")
    got = {r.path.rsplit("/", 1)[1]: r for r in audio.read_audio(spark, str(tmp_path)).collect()}
    assert got["A4.wav"].sample_rate == 8000 and len(got["A4.wav"].samples) == 4000
    assert got["bad.wav"].status.startswith("error")
    assert audio.inventory(spark, str(tmp_path)).count() == 2


def test_sheets_round_trip_and_merge(spark, tmp_path):
    base = spark.createDataFrame([("s1", "A4", None), ("s2", "B4", 2.0)], "sample_id string, note string, x double")
    extra = spark.createDataFrame([("A4", 1.0, 5)], "note string, x double, y int")
    sheets.write_sheets({"base": base, "extra": extra}, str(tmp_path / "book"))
    assert sheets.list_sheets(spark, str(tmp_path / "book")) == ["base", "extra"]
    got = {r.note: (r.x, r.y) for r in sheets.merged_sheets(spark, str(tmp_path / "book"), "base", ["extra", "absent"], "sample_id", "note").collect()}
    assert got == {"A4": (1.0, 5), "B4": (2.0, None)}


def test_manifest_problems(spark, tmp_path):
    (tmp_path / "m.csv").write_text("file_path,instrument,instrument_family,technique,written_pitch,sounding_pitch,dynamic,register,source,notes\na.wav,flute,,,,,,,,\na.wav,flute,,,,,,,,\n,x,,,,,,,,\nb.wav,,,,,,,,,\n")
    manifest = sheets.read_manifest(spark, str(tmp_path / "m.csv"))
    files = spark.createDataFrame([("a.wav",)], "path string")
    assert {(r.file_path, r.problem) for r in sheets.manifest_problems(manifest, files).collect()} == {(None, "blank_path"), ("a.wav", "duplicate"), ("b.wav", "missing_file")}


def test_notes(spark):
    df = spark.createDataFrame([("flute_C#4_mf.wav",), ("Bb3",), ("As2 pp",), ("nothing",), (None,)], "t string").select(notes.note_token(F.col("t")).alias("n")).select("n", notes.midi(F.col("n")).alias("m"))
    assert [(r.n, r.m) for r in df.collect()] == [("C#4", 61), ("Bb3", 58), ("A#2", 46), (None, None), (None, None)]


def test_paths(spark):
    df = spark.createDataFrame([(r"C:\a\b.wav",), ("/home/x/y",), ("http://a.b/home/c",), (None,)], "t string")
    assert [r.x for r in df.select(publication.redact(F.col("t")).alias("x")).collect()] == ["[path]", "[path]", "http://a.b/home/c", None]


def test_guards(spark):
    df = spark.createDataFrame([("1.5",), ("nan",), ("x",), (None,), ("3",)], "t string").select(guards.number(F.col("t")).alias("a"), guards.whole(F.col("t")).alias("b"))
    assert [(r.a, r.b) for r in df.collect()] == [(1.5, None), (None, None), (None, None), (None, None), (3.0, 3)]


def test_window_bandwidth():
    assert scales.window_enbw_bins("hann", 1024) == pytest.approx(1.5)
    assert scales.window_enbw_bins("boxcar", 64) == pytest.approx(1.0)


def test_bca_limits_and_scores_equal_brute_force(spark):
    """Scores, draws, jackknife and limits of one note, term by term."""
    rows = [(7, c, a) for c, a in (("H", 0.9), ("H", 0.4), ("H", 0.2), ("I", 0.3), ("I", 0.1), ("S", 0.05))]
    df = spark.createDataFrame(rows, "note long, comp string, amp double")
    got = one(uncertainty.bootstrap_scores(df, draws=200))

    def strict(items):
        e = sum(a * a for _, a in items)
        out = 0.0
        for c in "HIS":
            s = [math.log1p(a) for k, a in items if k == c]
            if s:
                out += sum(a * a for k, a in items if k == c) / e * sum(s) * sum(s) ** 2 / sum(x * x for x in s) / len(s)
        return out

    items = sorted((c, a) for _, c, a in rows)
    assert got.strict == pytest.approx(strict(items)) and got.n == 6
    parts = {c: [a for k, a in items if k == c] for c in "HIS"}
    m, samples = 2**31 - 1, []
    for b in range(200):
        drawn = []
        for k, c in enumerate("HIS"):
            for j in range(len(parts[c])):
                x = (7 * 7919 + b * 104729 + j * 1299709 + k * 15485863) % m
                x = (x * x + 12345) % m
                drawn.append((c, parts[c][(x * x + 6789) % m % len(parts[c])]))
        samples.append(strict(drawn))
    assert got.strict_low == pytest.approx(np.percentile(samples, 2.5)) and got.strict_high == pytest.approx(np.percentile(samples, 97.5))
    jack = np.array([strict(items[:i] + items[i + 1 :]) for i in range(6)])
    normal = NormalDist()
    z0, off = normal.inv_cdf(np.mean(np.array(samples) < got.strict)), jack.mean() - jack
    a = (off**3).sum() / (6 * (off**2).sum() ** 1.5)
    for q, x in ((0.025, got.strict_low_bca), (0.975, got.strict_high_bca)):
        z = z0 + normal.inv_cdf(q)
        assert x == pytest.approx(np.percentile(samples, 100 * normal.cdf(z0 + z / (1 - a * z))))


def test_draws_in_blocks_are_the_same_draws(monkeypatch):
    rng = np.random.default_rng(3)
    amp = rng.random(37)
    whole = uncertainty.drawn_sums(11, 5, 50, 1, amp, np.log1p(amp))
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(uncertainty, "_AT_ONCE", size)
        assert uncertainty.drawn_sums(11, 5, 50, 1, amp, np.log1p(amp)) == pytest.approx(whole, rel=1e-12)


def test_draws_of_a_million_components_are_bounded_in_memory():
    amp = np.linspace(0.1, 1, 1_000_000)
    s = np.log1p(amp)
    tracemalloc.start()
    sums = uncertainty.drawn_sums(1, 0, 6, 0, amp, s)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and sums[:, 0] == pytest.approx(np.full(6, s.sum()), rel=5e-3)


def test_scores_of_a_large_note_beside_small_ones(spark):
    """A note's compartments and a null compartment; order of rows and other notes don't matter."""
    large = spark.range(20_000).select(F.lit(1).cast("long").alias("note"), F.element_at(F.array(F.lit("H"), F.lit("I"), F.lit(None)), (F.col("id") % 3 + 1).cast("int")).alias("comp"), ((F.col("id") * 7919 % 1000 + 1) / 1000).alias("amp"))
    small = spark.createDataFrame([(2, "H", 0.5), (2, "H", 0.4), (2, "I", 0.1), (3, "S", 1.0), (3, "S", -1.0), (3, "S", None)], "note long, comp string, amp double")
    a = {r.note: r for r in uncertainty.bootstrap_scores(large.unionByName(small), draws=40).collect()}
    b = {r.note: r for r in uncertainty.bootstrap_scores(small.unionByName(large).orderBy("amp"), draws=40).collect()}
    assert {k: v.n for k, v in a.items()} == {1: 20_000, 2: 3, 3: 1}
    assert a[1].strict_low < a[1].strict < a[1].strict_high and a[3].strict_low is None
    for k in a:
        assert tuple(a[k]) == pytest.approx(tuple(b[k]), rel=1e-9, nan_ok=True) if k != 3 else a[k] == b[k]


def test_scores_of_two_components_have_no_interval(spark):
    got = one(uncertainty.bootstrap_scores(spark.createDataFrame([(1, "H", 0.5), (1, "I", 0.1)], "note long, comp string, amp double")))
    assert got.strict > 0 and got.strict_low is None and got.strict_high_bca is None


def test_normal_distribution(spark):
    p = [1e-6, 0.001, 0.02, 0.3, 0.5, 0.9, 0.999]
    df = spark.createDataFrame([(x,) for x in p], "p double").select("p", resolution.normal_quantile(F.col("p")).alias("z"))
    for r in df.withColumn("back", resolution.normal_cdf(F.col("z"))).collect():
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-6, abs=1e-8) and r.back == pytest.approx(r.p, abs=2e-7)


def test_ranks_over_many_ranges(spark):
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.normal(size=3000), np.repeat([0.5, -1.0], 200)])
    rows = normalise.average_ranks(spark.createDataFrame([(float(x),) for x in v], "v double"), [], "v").collect()
    order = np.sort(v)
    for r in rows[::17]:
        low, high = np.searchsorted(order, r.v, "left"), np.searchsorted(order, r.v, "right")
        assert r["rank"] == (low + 1 + high) / 2


def test_stretch_of_a_stiff_string_is_found(spark):
    f0, b = 110.3, 4e-4
    rows = [(1, 110.0, n * f0 * math.sqrt(1 + b * n * n)) for n in range(1, 25)]
    got = one(confirmation.rematched_stretch(spark.createDataFrame(rows, "note long, f0_hz double, freq_hz double")))
    assert got.fitted and got.b == pytest.approx(b, rel=0.1) and got.f0 == pytest.approx(f0, rel=1e-3)
