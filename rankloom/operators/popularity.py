"""Recipes that count: popular items, and popular by one event type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.operators.filters import training_events
from rankloom.operators.ranking import topk_global


def item_counts(ix: DataFrame) -> DataFrame:
    return ix.groupBy("ITEM_ID").agg(F.count(F.lit(1)).alias("score"))


def popularity(ix: DataFrame, k: int = 25) -> DataFrame:
    """Items by number of interactions, counted map-side before the shuffle."""
    return topk_global(item_counts(ix), k)


def popular_by_views(ix: DataFrame, k: int = 25, event_type: str = "view") -> DataFrame:
    """Items by number of interactions of one type."""
    return popularity(training_events(ix, event_type), k)
