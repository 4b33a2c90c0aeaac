"""The metric catalogue: names, status, aliases and formula versions as data that decide on columns."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "name string, status string, alias_of string, formula_version string"
CANONICAL, DIAGNOSTIC, LEGACY = "canonical", "diagnostic", "legacy"


def load(spark: SparkSession, path: str) -> DataFrame:
    """name, status, alias_of, formula_version of a JSON file ``{"metrics": [...]}``; read by Spark, so from any store.

    An entry without a name, a name that is there twice, an unknown status, or an alias of something
    that is not a metric itself is an error: a catalogue is checked before it decides.
    """
    text = spark.read.text(path, wholetext=True).collect()  # one file, and a catalogue is small
    if len(text) != 1:
        raise ValueError(f"{path}: one catalogue file, not {len(text)}")
    given = json.loads(text[0].value)
    if "metrics" not in given:
        raise ValueError(f"{path}: no list of metrics")
    rows = [(e.get("name"), e.get("status"), e.get("alias_of"), e.get("formula_version")) for e in given["metrics"]]
    names = [r[0] for r in rows]
    real = {r[0] for r in rows if r[2] is None}
    problems = [f"entry {i} has no name" for i, n in enumerate(names) if not n]
    problems += [f"{n} is there twice" for n in sorted({n for n in names if n and names.count(n) > 1})]
    problems += [f"{n}: status {s}" for n, s, a, _ in rows if a is None and s not in (CANONICAL, DIAGNOSTIC, LEGACY)]
    problems += [f"{n}: alias of {a}" for n, _, a, _ in rows if a is not None and a not in real]
    if problems:
        raise ValueError(f"{path}: " + "; ".join(problems))
    return spark.createDataFrame(rows, SCHEMA)


def classified(names: DataFrame, catalogue: DataFrame, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """``names`` (a column ``name``) with ``metric`` (an alias resolved), ``status``, ``formula_version`` and ``declared``.

    A name with one of ``prefixes`` is legacy whatever the catalogue says; an alias has the status
    of its metric; a name that is not declared is diagnostic.
    """
    own = catalogue.select("name", F.coalesce("alias_of", "name").alias("metric"))
    real = catalogue.filter("alias_of IS NULL").select(F.col("name").alias("metric"), F.col("status").alias("_status"), "formula_version")
    entries = own.join(real, "metric").select("name", F.col("metric").alias("_metric"), "_status", "formula_version")
    met = names.join(F.broadcast(entries), "name", "left")  # one row a catalogue entry
    old = F.lit(False)
    for p in prefixes:
        old = old | F.col("name").startswith(p)
    status = F.when(old, LEGACY).otherwise(F.coalesce("_status", F.lit(DIAGNOSTIC)))
    return met.withColumns({"metric": F.coalesce("_metric", "name"), "status": status, "declared": F.col("_metric").isNotNull()}).drop("_metric", "_status")


def drift(cells: DataFrame, catalogue: DataFrame, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """What (name, value) cells and the catalogue say of each other: name, metric, status, cells, missing, finding.

    findings: ``undeclared``, ``alias`` (to be renamed), ``retired`` (legacy, still written),
    ``absent`` (a canonical metric that no cell has, under its name or an alias), ``empty`` (no value), ``ok``.
    """
    counts = cells.groupBy("name").agg(F.count("*").alias("cells"), F.count_if(F.col("value").isNull() | F.isnan("value")).alias("missing"))
    seen = classified(counts, catalogue, prefixes)
    finding = F.when(F.col("status") == LEGACY, "retired").when(~F.col("declared"), "undeclared").when(F.col("name") != F.col("metric"), "alias").when(F.col("cells") == F.col("missing"), "empty").otherwise("ok")
    here = seen.select("name", "metric", "status", "cells", "missing", finding.alias("finding"))
    absent = catalogue.filter(f"alias_of IS NULL AND status = '{CANONICAL}'").join(seen.select(F.col("metric").alias("name")).distinct(), "name", "left_anti")
    zero = F.lit(0).cast("long")
    return here.unionByName(absent.select("name", F.col("name").alias("metric"), "status", zero.alias("cells"), zero.alias("missing"), F.lit("absent").alias("finding")))


def published(cells: DataFrame, catalogue: DataFrame, keys: list[str], statuses: tuple[str, ...] = (CANONICAL,), prefixes: tuple[str, ...] = ()) -> DataFrame:
    """(keys, metric, value) of the wanted statuses, aliases resolved: a metric's own name wins over an alias, of aliases the first by name that has a value."""
    known = classified(cells, catalogue, prefixes).filter(F.col("status").isin(*statuses) & F.col("value").isNotNull() & ~F.isnan("value"))
    best = F.min(F.struct((F.col("name") != F.col("metric")).alias("other"), "name", "value")).alias("best")
    return known.groupBy(*keys, "metric").agg(best).select(*keys, "metric", F.col("best.value").alias("value"))


def published_columns(rows: DataFrame, catalogue: DataFrame, statuses: tuple[str, ...] = (CANONICAL,), prefixes: tuple[str, ...] = ()) -> DataFrame:
    """A wide table's columns of the wanted statuses in first-seen order, under their metrics' names; the first non-null of several."""
    names = rows.sparkSession.createDataFrame([(c, i) for i, c in enumerate(rows.columns)], "name string, place int")
    kept = classified(names, catalogue, prefixes).filter(F.col("status").isin(*statuses)).orderBy("place").collect()  # one row a column
    groups: dict[str, list[str]] = {}
    for r in kept:
        groups.setdefault(r.metric, []).append(r.name)
    return rows.select(*[F.coalesce(*[F.col(f"`{c}`") for c in sorted(cs, key=lambda c, m=m: c != m)]).alias(m) for m, cs in groups.items()])
