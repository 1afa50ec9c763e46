"""Run logs: is earlier work still good, is there newer data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.operators.filters import STATUS_CREATING


def new_data_available(runs: DataFrame, newest: DataFrame, key: str = "parent") -> DataFrame:
    """Adds ``data_time`` and ``new_data``: data newer than the last run."""
    joined = runs.join(newest.select(key, "data_time"), key, "left")
    return joined.withColumn("new_data", F.coalesce(F.col("data_time") > F.col("last_updated"), F.lit(False)))


def freshness_gate(runs: DataFrame, requests: DataFrame, now: Column, key: str = "parent") -> DataFrame:
    """Requests with ``is_current``: may the earlier run be used as it is?

    A run is past its age once ``now`` is later than its last update plus
    ``max_age``. ``requests`` has the key and ``max_age`` (seconds; null or 0 for none) and
    may have ``name`` (compared with the run's) and ``data_time`` (newest data;
    null where there is no source to compare). ``runs`` has one row per key. A
    request without a run is not current.
    """
    named = "name" in requests.columns and "name" in runs.columns
    sourced = "data_time" in requests.columns
    joined = requests.alias("new").join(runs.alias("old"), key, "left")

    same_name = F.coalesce(F.col("old.name") == F.col("new.name"), F.lit(False)) if named else F.lit(False)
    usable = F.coalesce(F.col("old.status").isin(*STATUS_CREATING), F.lit(False))
    aged = F.coalesce(F.col("new.max_age"), F.lit(0)) != 0
    past = now > F.timestamp_add("SECOND", F.col("new.max_age"), F.col("old.last_updated"))
    newer = F.coalesce(F.col("new.data_time") > F.col("old.last_updated"), F.lit(True)) if sourced else F.lit(True)
    is_current = (
        F.when(same_name, True)
        .when(~usable, False)
        .when(aged & (F.col("old.status") == "ACTIVE"), ~(past & newer))
        .otherwise(True)
    )
    return joined.select("new.*", F.coalesce(is_current, F.lit(False)).alias("is_current"))
