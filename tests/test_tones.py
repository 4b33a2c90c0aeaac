"""Tones heard by tables of their orders' products, without their samples."""

from __future__ import annotations

import math
import random

from sonagrid.operators import fundamental

RATE = 8000.0


def test_tones_of_one_fundamental_make_no_samples(spark, monkeypatch):
    """Notes of three fundamentals and two lengths by tables, one of a fourth and odd ones by samples: candidates are those of their samples, to eight decimals."""
    r = random.Random(4)
    some = lambda n: [r.choice((0.0, r.random())) for _ in range(n)]
    rows = [(k, (50.0, 187.5, 440.0)[k % 3], some(3 + k % 2)) for k in range(1200)] + [(2000, 300.0, [0.5, 0.2])]
    odd = [(50.0, []), (50.0, None), (None, [1.0]), (0.0, [1.0, 0.5]), (50.0, [0.0] * 3), (50.0, [math.inf, 1.0, 0.0]), (50.0, [None, math.nan, 1.0]), (-50.0, [1.0]), (2500.0, [1.0]), (50.0, [1e-200, 0.0, 1e-200]), (50.0, [1.0] * 20)]
    notes = spark.createDataFrame([*rows, *((3000 + i, *x) for i, x in enumerate(odd))], "k long, f0 double, amps array<double>").coalesce(1).cache()
    want = fundamental.candidates(fundamental.tones(notes, "k", "f0", "amps", 2000, RATE), "k", "samples", "rate", 40.0, 2000.0)
    got = fundamental.tone_candidates(notes, "k", "f0", "amps", 2000, RATE, 40.0, 2000.0)
    assert got.schema == want.schema and got.count() > 2000
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    made = []
    monkeypatch.setattr(fundamental, "_sounding", lambda *_: lambda batches: made.extend(b.num_rows for b in batches) or [])
    hear = fundamental._hearing("k", 2000, RATE, 40.0, 2000.0)
    assert sum(b.num_rows for b in hear(iter(notes.toArrow().to_batches()))) > 2000 and sum(made) == 1 + len(odd) - 2  # the silent note, and one of a single order, need none
