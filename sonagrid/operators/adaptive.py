"""Order-dependent profile learning: a fold over a key's observations in a stated order.

alpha <- (1 - forget) alpha + gain o, where o is an observed share triple; the gain falls with the
Jensen-Shannon divergence of o from the profile and grows with the evidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonagrid.functions.guards import js_divergence

FORGET, TEMPERATURE, START = 0.02, 0.18, 8.0 / 3.0


def fold(observations: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Final alpha per key; observations have o1, o2, o3 (shares) and evidence.

    One aggregate over each key's sorted array: the observations of one key must fit a task; a key's
    history is a sequence, so it can't be split. Keys are independent.
    """
    item = F.struct(*order, "o1", "o2", "o3", "evidence")
    rows = observations.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("xs"))
    start = F.struct(*[F.lit(START).alias(f"a{i}") for i in (1, 2, 3)])

    def step(s, x):
        a = [s[f"a{i}"] for i in (1, 2, 3)]
        total = a[0] + a[1] + a[2]
        p, q = [v / total for v in a], [x[f"o{i}"] for i in (1, 2, 3)]
        gain = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.exp(-js_divergence(p, q) / TEMPERATURE)))
        gain = gain * F.greatest(F.lit(0.25), F.least(F.lit(4.0), x["evidence"]))
        return F.struct(*[((1 - FORGET) * v + gain * o).alias(f"a{i}") for i, (v, o) in enumerate(zip(a, q, strict=True), 1)])

    out = rows.select(key, F.size("xs").cast("long").alias("observations"), F.aggregate("xs", start, step).alias("s"))
    return out.select(key, "observations", "s.a1", "s.a2", "s.a3")
