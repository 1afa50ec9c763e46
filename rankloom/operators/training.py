"""Solution versions: full retraining behind a freshness gate."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.runlog import freshness_gate
from rankloom.sources.snapshots import commit_log, write_version


def retrain_full(
    ix: DataFrame,
    recipe: Callable[[DataFrame], DataFrame],
    root: str,
    solution: str,
    max_age: int | None = None,
    force: bool = False,
    now: datetime | None = None,
) -> int | None:
    """Run ``recipe`` on all of ``ix`` and store it as the next version.

    Returns the new version, or None if the last one is still current.
    """
    spark = ix.sparkSession
    now = now or datetime.now(timezone.utc)
    if not force and _is_current(spark, root, solution, max_age, now):
        return None
    return write_version(recipe(ix), root, solution, now)


def _is_current(spark, root: str, solution: str, max_age: int | None, now: datetime) -> bool:
    newest = Window.partitionBy("name").orderBy(F.col("version").desc())
    last = (
        commit_log(spark, root)
        .where(F.col("name") == solution)
        .withColumn("_place", F.row_number().over(newest))
        .where(F.col("_place") == 1)
        .select(F.col("name").alias("parent"), "status", "last_updated")
    )
    request = spark.range(1).select(F.lit(solution).alias("parent"), F.lit(max_age).cast("long").alias("max_age"))
    return freshness_gate(last, request, F.lit(now)).first().is_current
