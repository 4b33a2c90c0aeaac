"""Several tables as one version: written aside, then named by one manifest; readers follow the newest manifest.

A writer that fails, or loses a race, leaves files that no manifest names, and the version before
stays readable as it was. A manifest is made by a rename, which the file system does wholly or not at all.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDER = "_versions"


def _system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the versions there are, ascending."""
    system, path = _system(spark, f"{folder.rstrip('/')}/{_FOLDER}")
    if not system.exists(path):
        return []
    names = [f.getPath().getName() for f in system.listStatus(path)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def manifest(spark: SparkSession, folder: str, version: int | None = None) -> dict:
    """What a version holds: version, tables (name -> path below the folder), notes."""
    have = versions(spark, folder)
    if not have:
        raise FileNotFoundError(f"{folder}: no version yet")
    number = have[-1] if version is None else version
    return json.loads(spark.read.text(f"{folder.rstrip('/')}/{_FOLDER}/{number}.json", wholetext=True).first().value)


def commit(spark: SparkSession, folder: str, tables: dict[str, DataFrame], keep: bool = False, notes: dict | None = None) -> int:
    """Writes all tables, then the manifest; returns the version. ``keep`` carries tables over that are not written anew.

    Of two writers the one whose manifest comes second gets an error, not a mixture.
    """
    folder = folder.rstrip("/")
    have = versions(spark, folder)
    number = have[-1] + 1 if have else 1
    mark = uuid.uuid4().hex
    named = dict(manifest(spark, folder)["tables"]) if keep and have else {}
    for name, rows in tables.items():
        if not name or "/" in name or name.startswith(("_", ".")):
            raise ValueError(f"{name!r} can't name a table")
        rows.write.mode("error").parquet(f"{folder}/{name}/{number}-{mark}")
        named[name] = f"{name}/{number}-{mark}"
    body = json.dumps({"version": number, "tables": named, "notes": notes or {}}, sort_keys=True)
    system, aside = _system(spark, f"{folder}/{_FOLDER}/.{mark}")
    out = system.create(aside, False)
    try:
        out.write(bytearray(body.encode()))
    finally:
        out.close()
    final = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{_FOLDER}/{number}.json")
    if system.exists(final) or not system.rename(aside, final):
        system.delete(aside, False)
        raise FileExistsError(f"{folder}: version {number} was committed by another writer")
    return number


def read(spark: SparkSession, folder: str, name: str, version: int | None = None) -> DataFrame:
    """A table of the newest version, or of a stated one."""
    named = manifest(spark, folder, version)["tables"]
    if name not in named:
        raise KeyError(f"{folder}: version has no table {name}")
    return spark.read.parquet(f"{folder.rstrip('/')}/{named[name]}")


def vacuum(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Deletes older manifests and the files that only they, or no manifest, name; returns the paths. Not while a writer is at work."""
    folder = folder.rstrip("/")
    have = versions(spark, folder)
    held = {p for v in have[-keep:] for p in manifest(spark, folder, v)["tables"].values()}
    system, top = _system(spark, folder)
    gone = []
    for table in system.listStatus(top) if system.exists(top) else []:
        name = table.getPath().getName()
        if table.isDirectory() and not name.startswith(("_", ".")):
            gone += [f"{name}/{part.getPath().getName()}" for part in system.listStatus(table.getPath()) if f"{name}/{part.getPath().getName()}" not in held]
    gone += [f"{_FOLDER}/{v}.json" for v in have[:-keep]]
    for path in gone:
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{path}"), True)
    return gone
