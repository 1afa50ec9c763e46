"""Dataset snapshots and versioned results in one shared folder.

A table is written to a folder of its own first; only then a row that names it
as the next version is added to the commit log. Readers take the newest
committed version, so they never see half an import. A version can be committed
once, as its row is a file that is put in place only if none is there: of two
writers that follow the same version, however close, the later one fails and
changes nothing.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.sources.commits import delete, put_if_absent

LOG_SCHEMA = "name string, version long, status string, created timestamp, last_updated timestamp, folder string"


def commit_log(spark: SparkSession, root: str) -> DataFrame:
    """All commits below ``root``: a run log of name, version, status, times, folder."""
    try:
        return spark.read.schema(LOG_SCHEMA).json(f"{root}/_commits/*.json")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return spark.createDataFrame([], LOG_SCHEMA)
        raise


def current_version(spark: SparkSession, root: str, name: str) -> int:
    """The newest committed version, 0 if there is none. The log has one row
    per import, so this reads a handful of rows."""
    log = commit_log(spark, root).where(F.col("name") == name)
    return log.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version")).first().version


def write_version(df: DataFrame, root: str, name: str, now: datetime | None = None, after: int | None = None) -> int:
    """Write ``df`` as the next version of ``name`` and commit it.

    ``after`` is the version the caller has read; it is an error if it is no
    longer the newest one.
    """
    spark = df.sparkSession
    newest = current_version(spark, root, name)
    if after is not None and after != newest:
        raise ValueError(f"{name} is at version {newest}, not {after} any more")
    version = newest + 1
    folder = f"{name}/version={version}-{uuid.uuid4().hex}"
    started = now or datetime.now(timezone.utc)
    df.write.mode("errorifexists").parquet(f"{root}/{folder}")
    finished = now or datetime.now(timezone.utc)
    row = {
        "name": name, "version": version, "status": "ACTIVE",
        "created": started.isoformat(), "last_updated": finished.isoformat(), "folder": folder,
    }
    if not put_if_absent(spark, f"{root}/_commits/{name}.{version}.json", json.dumps(row)):
        delete(spark, f"{root}/{folder}")
        raise ValueError(f"{name} is not at version {newest} any more")
    return version


def read_snapshot(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A version of ``name``, by default the newest committed one."""
    chosen = version or current_version(spark, root, name)
    log = commit_log(spark, root).where((F.col("name") == name) & (F.col("version") == chosen)).first()
    if log is None:
        raise ValueError(f"{name} has no version {chosen}" if chosen else f"{name} has never been imported")
    return spark.read.parquet(f"{root}/{log.folder}")


def full_import(df: DataFrame, root: str, dataset: str) -> int:
    """Replace the dataset as a whole; returns the new version."""
    return write_version(df, root, dataset)
