"""Results that grow: versions of a table, of which the last one committed counts.

A version is written to a folder of its own, and counts from the moment that a small file
names it.  A job that dies before leaves the version before it readable; two jobs that
commit the same version can't both succeed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.registry import merge_results


class Conflict(RuntimeError):
    """Another job has committed the version."""


def _store(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([path.rstrip("/"), *parts]))
    return at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _commits(spark: SparkSession, path: str) -> dict[int, str]:
    """Folders of committed versions; a commit that its job didn't finish names none."""
    store, at = _store(spark, path)
    out = {}
    if store.exists(at("_commits")):
        for status in store.listStatus(at("_commits")):
            name = status.getPath().getName()
            if name.isdigit() and status.getLen():
                source = store.open(status.getPath())
                try:
                    out[int(name)] = source.readUTF()
                finally:
                    source.close()
    return out


def _last(spark: SparkSession, path: str) -> int:
    """The last version that was begun to be committed; 0 if there is none."""
    store, at = _store(spark, path)
    found = [s.getPath().getName() for s in store.listStatus(at("_commits"))] if store.exists(at("_commits")) else []
    return max((int(n) for n in found if n.isdigit()), default=0)


def current(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The last committed version, or the one asked for; None if there is none."""
    commits = _commits(spark, path)
    number = version if version is not None else max(commits, default=0)
    return spark.read.parquet(f"{path.rstrip('/')}/{commits[number]}") if number in commits else None


def commit(rows: DataFrame, path: str, after: int | None = None) -> int:
    """rows as the next version; its number.  after, if given, is the last version that the writer has seen."""
    spark = rows.sparkSession
    number = (_last(spark, path) if after is None else after) + 1
    folder = f"version-{number:08d}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path.rstrip('/')}/{folder}")
    store, at = _store(spark, path)
    try:
        out = store.create(at("_commits", f"{number:08d}"), False)
    except Exception as e:
        if store.exists(at("_commits", f"{number:08d}")):
            raise Conflict(f"version {number} of {path} was committed by another job") from e
        raise
    try:
        out.writeUTF(folder)
    finally:
        out.close()
    return number


def merge(new: DataFrame, path: str, key: str = "step") -> int:
    """The last version with new results in place of old ones of their keys, as the next version."""
    spark = new.sparkSession
    seen, old = _last(spark, path), current(spark, path)
    return commit(new if old is None else merge_results(old, new, key), path, seen)


def clean(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes versions but the last ones, and folders that no commit names; how many.  No writer may be at work."""
    store, at = _store(spark, path)
    commits = _commits(spark, path)
    kept = {commits[n] for n in sorted(commits)[-keep:]}
    gone = [s.getPath() for s in store.listStatus(at()) if s.getPath().getName().startswith("version-") and s.getPath().getName() not in kept]
    for folder in gone:
        store.delete(folder, True)
    for n in sorted(commits)[:-keep]:
        store.delete(at("_commits", f"{n:08d}"), False)
    return len(gone)
