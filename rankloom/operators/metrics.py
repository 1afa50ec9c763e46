"""Offline accuracy of ranked lists against held-out interactions.

Textbook definitions, averaged over the users with held-out items; a user
without a list scores zero.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.numeric import round6

NDCG_DEPTHS = (5, 10, 25)
PRECISION_DEPTHS = (5, 10, 25)
MRR_DEPTH = 25


def temporal_split(ix: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """(train, held-out): rows before the cutoff; distinct (user, item) from it on."""
    train = ix.where(F.col("TS") < cutoff)
    held = ix.where(F.col("TS") >= cutoff).select("USER_ID", "ITEM_ID").distinct()
    return train, held


def hits_by_user(lists: DataFrame, held: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The one hit table behind all rank metrics: a row per held-out user (and value of ``by``)."""
    by = by or []
    ranked = lists.select(*by, "USER_ID", "ITEM_ID", "rank")
    hit = held.join(ranked, [*by, "USER_ID", "ITEM_ID"], "left")

    def gain(depth: int) -> Column:
        inside = F.col("rank") <= depth
        return F.sum(F.when(inside, F.lit(1.0) / F.log2(F.col("rank") + 1.0)).otherwise(0.0))

    def hits(depth: int) -> Column:
        return F.sum(F.when(F.col("rank") <= depth, 1).otherwise(0))

    return hit.groupBy(*by, "USER_ID").agg(
        F.count(F.lit(1)).alias("relevant"),
        F.min(F.when(F.col("rank") <= MRR_DEPTH, F.col("rank"))).alias("first_hit"),
        *[gain(d).alias(f"gain_{d}") for d in NDCG_DEPTHS],
        *[hits(d).alias(f"hits_{d}") for d in PRECISION_DEPTHS],
    )


def _ideal_gain(depth: int) -> Column:
    """Gain of a perfect list, looked up by min(relevant, depth)."""
    sums, total = [], 0.0
    for rank in range(1, depth + 1):
        total += 1.0 / math.log2(rank + 1)
        sums.append(total)
    return F.element_at(F.array(*[F.lit(s) for s in sums]), F.least(F.col("relevant"), F.lit(depth)).cast("int"))


def rank_metrics(
    lists: DataFrame, held: DataFrame, setting: str | None = None, settings: Iterable[int] = ()
) -> DataFrame:
    """One row with the seven rank metrics, from one pass over the hit table.

    With a column ``setting`` in the lists, one row for each of ``settings``, also for
    those whose lists hit nothing.
    """
    by = [setting] if setting else []
    if setting:
        held = held.withColumn(setting, F.explode(F.array(*map(F.lit, settings))))
    per_user = hits_by_user(lists, held, by)
    return per_user.groupBy(*by).agg(
        round6(F.avg(F.coalesce(F.lit(1.0) / F.col("first_hit"), F.lit(0.0)))).alias("mean_reciprocal_rank_at_25"),
        *[
            round6(F.avg(F.col(f"gain_{d}") / _ideal_gain(d))).alias(f"normalized_discounted_cumulative_gain_at_{d}")
            for d in NDCG_DEPTHS
        ],
        *[round6(F.avg(F.col(f"hits_{d}") / F.lit(float(d)))).alias(f"precision_at_{d}") for d in PRECISION_DEPTHS],
    )


def coverage(lists: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Distinct recommended items over distinct catalogue items, one row."""
    tagged = (
        lists.select("ITEM_ID", F.lit(1).alias("listed"), F.lit(0).alias("known"))
        .unionByName(catalogue.select("ITEM_ID", F.lit(0).alias("listed"), F.lit(1).alias("known")))
        .groupBy("ITEM_ID")
        .agg(F.max("listed").alias("listed"), F.max("known").alias("known"))
    )
    return tagged.agg(round6(F.sum("listed") / F.sum("known")).alias("coverage"))


def offline_metrics(lists: DataFrame, held: DataFrame, catalogue: DataFrame) -> DataFrame:
    """All eight metrics in long form: name, value."""
    wide = rank_metrics(lists, held)
    long = wide.unpivot([], wide.columns, "name", "value")
    covered = coverage(lists, catalogue)
    return long.unionByName(covered.unpivot([], covered.columns, "name", "value"))


def metrics_by_version(long: DataFrame, solution: str, version: int) -> DataFrame:
    """Metric points with the version they judge, ready to append."""
    return long.select(F.lit(solution).alias("solution"), F.lit(version).cast("long").alias("version"), "name", "value")
