"""Several tables published as one version: readers see all of the old ones or all of the new ones, and any version can be made current again.

Tables are written under the hash of their rows, so a version that changes one table of ten writes one. A version is a manifest that names the
tables' paths; it is written last, in a folder of its own number that must not be there yet, so a failed publication leaves files that nobody
reads, and of two publications at once one fails and can try again on what the other published.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import write_once

MANIFEST = "version long, name string, path string, restored long"
WIDTH = 12


class Conflict(RuntimeError):
    """Another publication took the version."""


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """(version, name, path, restored) of every version; no rows before the first. Writes that were not finished are not seen."""
    try:
        return spark.read.schema(MANIFEST).json(f"{root.rstrip('/')}/manifests/*")
    except AnalysisException as x:
        if x.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def current(spark: SparkSession, root: str) -> int | None:
    """The number of the newest version; None before the first."""
    return manifests(spark, root).agg(F.max("version")).first()[0]


def _commit(spark: SparkSession, root: str, version: int, paths: dict[str, str], restored: int | None, mode: str = "errorifexists") -> int:
    rows = spark.createDataFrame([(version, name, path, restored) for name, path in sorted(paths.items())], MANIFEST)
    try:
        rows.coalesce(1).write.mode(mode).json(f"{root.rstrip('/')}/manifests/v{version:0{WIDTH}d}")
    except AnalysisException as x:
        if x.getCondition() == "PATH_ALREADY_EXISTS":
            raise Conflict(f"version {version} is taken; if its publication has ended without it, see abandon") from x
        raise
    return version


def publish(tables: dict[str, DataFrame], root: str, on: int | None = None) -> int:
    """Write tables and make them the current version; its number. Tables of the version before that are not named stay in it.

    With `on`, the publication holds only if that version is still the newest one.
    """
    if not tables:
        raise ValueError("no tables to publish")
    spark = next(iter(tables.values())).sparkSession
    newest = current(spark, root)
    if on is not None and on != newest:
        raise Conflict(f"version {newest} came after {on}")
    held = _paths(spark, root, newest) if newest is not None else {}
    fresh = {name: write_once(df, f"{root.rstrip('/')}/tables/{name}") for name, df in tables.items()}
    return _commit(spark, root, (newest or 0) + 1, held | fresh, None)


def _paths(spark: SparkSession, root: str, version: int) -> dict[str, str]:
    """Paths by table name: one row a table, so this is as long as the list of tables."""
    found = {r["name"]: r["path"] for r in manifests(spark, root).filter(F.col("version") == version).collect()}
    if not found:
        raise LookupError(f"no version {version}")
    return found


def load(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table as of a version, the current one if none is named."""
    version = current(spark, root) if version is None else version
    if version is None:
        raise LookupError("nothing is published")
    paths = _paths(spark, root, version)
    if name not in paths:
        raise LookupError(f"version {version} has no table {name}")
    return spark.read.parquet(paths[name])


def rollback(spark: SparkSession, root: str, version: int) -> int:
    """Make an earlier version current again, as a new version that names its tables; the new number. History stays."""
    return _commit(spark, root, current(spark, root) + 1, _paths(spark, root, version), version)


def abandon(spark: SparkSession, root: str) -> int | None:
    """Free the number that a publication took and, its driver lost, never finished: it becomes a copy of the version before. The newest version.

    Only for publications that are known to have ended. Without an earlier version there is nothing to copy: remove the folder by hand.
    """
    newest = current(spark, root)
    return None if newest is None else _commit(spark, root, newest + 1, _paths(spark, root, newest), newest, "overwrite")
