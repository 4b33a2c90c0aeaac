"""Tiered resolution, the metric catalogue, versions of several tables, and streams that are stopped and restarted."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sonagrid.operators import adaptive, tiers
from sonagrid.sources import catalogue, versions
from sonagrid.streaming import profiles, sinks

# --- tiers ---


def test_first_tier_with_one_match(spark):
    rows = spark.createDataFrame([(1, "a", "n1"), (2, "dup", "n2"), (3, "dup", "n1"), (4, None, "n1"), (5, " ", None), (6, "zz", "zz"), (7, "a", "n2")], "id long, file string, note string")
    targets = spark.createDataFrame([("T1", "a", "n1"), ("T2", "dup", "n2"), ("T3", "dup", "n3"), ("T4", None, "n2"), ("T5", " ", "n4")], "target string, file string, note string")
    by = [("file", F.col("file"), F.col("file")), ("note", F.col("note"), F.col("note"))]
    got = {x.id: tuple(x)[1:] for x in tiers.resolve(rows, targets, "id", "target", by).collect()}
    assert got == {
        1: ("T1", "file", "matched", 1),
        2: ("T2", "file", "ambiguous", 2),  # two by file, two by note: the first tier's smallest
        3: ("T1", "note", "matched", 1),  # two by file, one by note
        4: ("T1", "note", "matched", 1),
        5: (None, None, "unmatched", 0),
        6: (None, None, "unmatched", 0),
        7: ("T1", "file", "matched", 1),
    }
    assert tiers.resolve(rows.filter("false"), targets, "id", "target", by).count() == 0
    assert {x.status for x in tiers.resolve(rows, targets.filter("false"), "id", "target", by).collect()} == {"unmatched"}


def test_hints_fill_blanks_only(spark):
    rows = spark.createDataFrame([("A4", "x.wav", 1), ("B4", " ", 2), ("C4", None, 3), ("D4", "NaN", 4), (None, None, 5)], "note string, file string, k int")
    hints = spark.createDataFrame([("A4", "no.wav"), ("B4", "b1.wav"), ("B4", "b2.wav"), ("C4", ""), ("D4", "d.wav"), (None, "never.wav")], "note string, file string")
    got = {x.k: x.file for x in tiers.filled(rows, hints, "note", "file").collect()}
    assert got == {1: "x.wav", 2: "b2.wav", 3: None, 4: "d.wav", 5: None}
    assert tiers.filled(rows.drop("file"), hints, "note", "file").filter("file IS NOT NULL").count() == 3


# --- catalogue ---


def entries(spark, tmp_path, metrics):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"metrics": metrics}))
    return catalogue.load(spark, path.as_uri())


GOOD = [{"name": "a", "status": "canonical"}, {"name": "b", "status": "diagnostic"}, {"name": "old_a", "alias_of": "a"}, {"name": "z", "status": "canonical"}, {"name": "gone", "status": "legacy"}]


@pytest.mark.parametrize("bad", [{"name": "a", "status": "canonical"}, {"status": "canonical"}, {"name": "c", "status": "new"}, {"name": "c", "alias_of": "nothing"}, {"name": "c", "alias_of": "old_a"}])
def test_a_wrong_catalogue_is_refused(spark, tmp_path, bad):
    assert entries(spark, tmp_path, GOOD).count() == 5
    with pytest.raises(ValueError, match="c.json"):
        entries(spark, tmp_path, [*GOOD, bad])


def test_catalogue_decides_on_columns(spark, tmp_path):
    known = entries(spark, tmp_path, GOOD)
    wide = spark.createDataFrame([(1, 2.0, None, 4.0, 5.0), (2, None, 3.0, 4.0, 5.0)], "b int, old_a double, a double, extra double, gone double")
    got = catalogue.published_columns(wide, known)
    assert got.columns == ["a"] and [x.a for x in got.collect()] == [2.0, 3.0]
    both = catalogue.published_columns(wide, known, ("canonical", "diagnostic"), ("ext",))
    assert both.columns == ["b", "a"]
    cells = wide.unpivot([], ["old_a", "a", "extra", "gone"], "name", "value")
    found = {x.name: (x.finding, x.metric) for x in catalogue.drift(cells, known).collect()}
    assert found == {"old_a": ("alias", "a"), "a": ("ok", "a"), "extra": ("undeclared", "extra"), "gone": ("retired", "gone"), "z": ("absent", "z")}
    assert {x.name for x in catalogue.drift(cells.filter("false"), known).collect()} == {"a", "z"}


# --- versions ---


def test_readers_follow_the_manifest(spark, tmp_path):
    folder = tmp_path.as_uri()
    one, two = spark.range(3).toDF("x"), spark.range(5).toDF("x")
    with pytest.raises(FileNotFoundError):
        versions.read(spark, folder, "a")
    assert versions.commit(spark, folder, {"a": one, "b": one}, notes={"by": "test"}) == 1
    fails = F.udf(lambda x: 1 // 0, "int")
    with pytest.raises(Exception, match="ZeroDivision"):  # the first table is written by then, the second is not
        versions.commit(spark, folder, {"a": two, "b": two.select(fails("x").alias("x"))})
    assert versions.versions(spark, folder) == [1]
    assert versions.read(spark, folder, "a").count() == versions.read(spark, folder, "b").count() == 3
    assert versions.commit(spark, folder, {"a": two}, keep=True) == 2
    assert versions.read(spark, folder, "a").count() == 5 and versions.read(spark, folder, "b").count() == 3
    assert versions.read(spark, folder, "a", 1).count() == 3 and versions.manifest(spark, folder, 1)["notes"] == {"by": "test"}
    assert versions.commit(spark, folder, {"a": one}) == 3
    with pytest.raises(KeyError):
        versions.read(spark, folder, "b")
    gone = versions.vacuum(spark, folder, keep=2)
    assert len([g for g in gone if g.startswith("a/")]) == 2 and versions.versions(spark, folder) == [2, 3]
    assert versions.read(spark, folder, "a", 2).count() == 5 and versions.read(spark, folder, "b", 2).count() == 3


def test_the_second_of_two_writers_fails(spark, tmp_path, monkeypatch):
    folder = tmp_path.as_uri()
    versions.commit(spark, folder, {"a": spark.range(3)})
    monkeypatch.setattr(versions, "versions", lambda *_: [])  # as one sees it who listed before the other's commit
    with pytest.raises(FileExistsError):
        versions.commit(spark, folder, {"a": spark.range(9)})
    monkeypatch.undo()
    assert versions.read(spark, folder, "a").count() == 3


# --- streams ---


def test_a_stopped_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Half of the files, then the rest after a restart: the rows of the batch fold over all."""
    rows = [(k, t, 0.2 + 0.1 * (t % 5), 0.5 - 0.05 * (t % 5), 0.3 - 0.05 * (t % 5), 1.0 + t % 3) for k in range(4) for t in range(40)]
    schema = "k long, t long, o1 double, o2 double, o3 double, evidence double"
    files, folder = tmp_path / "in", (tmp_path / "out").as_uri()
    put = lambda a, b: spark.createDataFrame([r for r in rows if a <= r[1] < b], schema).coalesce(1).write.mode("append").parquet(files.as_uri())
    run = lambda: sinks.start(profiles.adaptive_profile(spark.readStream.schema(schema).parquet(files.as_uri()), "k", "t"), folder, "update").awaitTermination()
    put(0, 11)
    put(11, 20)
    run()
    half = {x.k: x.observations for x in sinks.latest(spark, folder, ["k"]).collect()}
    assert half == dict.fromkeys(range(4), 20)
    put(20, 40)
    run()
    got = {x.k: tuple(x)[1:] for x in sinks.latest(spark, folder, ["k"]).select("k", "observations", "a1", "a2", "a3").collect()}
    want = {x.k: tuple(x)[1:] for x in adaptive.fold(spark.createDataFrame(rows, schema), "k", ["t"]).collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)
