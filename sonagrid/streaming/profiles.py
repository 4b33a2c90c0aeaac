"""Streams (an extension: the batch operators have no unbounded sources).

Hopped activity and sessions are event-time windows with a watermark; the adaptive profile keeps
three numbers a key in state and takes observations in the order of their time within each batch, so
it equals the batch fold if batches arrive in order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonagrid.operators.adaptive import FORGET, START, TEMPERATURE


def activity(events: DataFrame, time: str, key: str, size: str, hop: str, late: str) -> DataFrame:
    """Events per key and sliding window; rows later than ``late`` are dropped."""
    return events.withWatermark(time, late).groupBy(key, F.window(time, size, hop).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("started"), "n")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    return events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("samples")).select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "samples")


def step(alpha: tuple[float, float, float], o: tuple[float, float, float], evidence: float) -> tuple[float, float, float]:
    """One update of the profile."""
    total = sum(alpha)
    p = [a / total for a in alpha]
    kl = lambda x, m: sum(u * math.log(u / v) for u, v in zip(x, m, strict=True) if u > 0 and v > 0)
    mid = [(x + y) / 2 for x, y in zip(p, o, strict=True)]
    gain = min(1.0, max(0.1, math.exp(-(0.5 * kl(p, mid) + 0.5 * kl(o, mid)) / TEMPERATURE))) * min(4.0, max(0.25, evidence))
    return tuple((1 - FORGET) * a + gain * x for a, x in zip(alpha, o, strict=True))


def adaptive_profile(observations: DataFrame, key: str, order: str | list[str]) -> DataFrame:
    """Running profile per key: the state after each micro-batch. Observations: key, order, o1, o2, o3, evidence."""
    kind = observations.schema[key].dataType.simpleString()

    def update(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, *alpha = state.get if state.exists else (0, START, START, START)
        for x in pd.concat(list(batches)).sort_values(order, kind="stable").itertuples(index=False):
            alpha, n = step(tuple(alpha), (x.o1, x.o2, x.o3), x.evidence), n + 1
        state.update((n, *map(float, alpha)))
        yield pd.DataFrame({key: [k[0]], "observations": [n], "a1": [alpha[0]], "a2": [alpha[1]], "a3": [alpha[2]]})

    return observations.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, observations long, a1 double, a2 double, a3 double", "n long, a1 double, a2 double, a3 double", "update", "NoTimeout")
