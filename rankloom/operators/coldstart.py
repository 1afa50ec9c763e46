"""Items nobody has chosen yet, and the update that brings them in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.ranking import topk
from rankloom.session import materialise


def cold_items(ix: DataFrame, items: DataFrame, attribute: str, k: int = 25) -> DataFrame:
    """Per user, the best ``k`` items without interactions: USER_ID, ITEM_ID,
    score, rank. The score is how often the user chose the item's attribute value.
    """
    known = ix.select("ITEM_ID").distinct()
    fresh = items.select("ITEM_ID", attribute).join(known, "ITEM_ID", "left_anti")
    return score_by_profile(ix, items, fresh, attribute, k)


def score_by_profile(ix: DataFrame, items: DataFrame, fresh: DataFrame, attribute: str, k: int) -> DataFrame:
    """Items sharing a value score alike for a user and tie by id, so only the
    ``k`` smallest ids of each value can reach a list of ``k``: the fan-out per
    (user, value) is k, however many new items hold the value. That short table
    is written first, so that it is broadcast if small and AQE can split the
    users of a common value if it is not."""
    profile = (
        ix.select("USER_ID", "ITEM_ID")
        .join(items.select("ITEM_ID", attribute), "ITEM_ID")
        .groupBy("USER_ID", attribute)
        .agg(F.count(F.lit(1)).alias("score"))
    )
    by_id = Window.partitionBy(attribute).orderBy("ITEM_ID")
    reachable = fresh.withColumn("_place", F.row_number().over(by_id)).where(F.col("_place") <= k).drop("_place")
    reachable = materialise(reachable, "reachable")
    scored = profile.join(reachable, attribute).select("USER_ID", "ITEM_ID", "score")
    return topk(scored, k, by=["USER_ID"]).select("USER_ID", "ITEM_ID", "score", "rank")


def new_items(items: DataFrame, versioned_items: DataFrame) -> DataFrame:
    """Items the last version did not know."""
    return items.join(versioned_items.select("ITEM_ID").distinct(), "ITEM_ID", "left_anti")


def update_new_items(
    existing: DataFrame,
    versioned_items: DataFrame,
    ix: DataFrame,
    items: DataFrame,
    attribute: str,
    k: int = 25,
    versioned_ix: DataFrame | None = None,
) -> DataFrame:
    """UPDATE training: ``existing`` rows stay as they are, and rows for items
    new to the model join them.

    New are items added since the last version. With ``versioned_ix``, the
    interactions of that version, also those that have had their first
    interaction since. Raises if neither an item nor an interaction was added.
    """
    fresh = new_items(items, versioned_items).select("ITEM_ID", attribute)
    changed = False
    if versioned_ix is not None:
        added_ix = ix.select("USER_ID", "ITEM_ID").join(versioned_ix, ["USER_ID", "ITEM_ID"], "left_anti")
        first = new_items(added_ix.select("ITEM_ID").distinct(), versioned_ix)
        fresh = fresh.unionByName(items.select("ITEM_ID", attribute).join(first, "ITEM_ID", "left_semi")).distinct()
        changed = not added_ix.isEmpty()
    if not changed and fresh.isEmpty():
        raise ValueError("nothing was added since the last version, so an update has nothing to learn")
    added = score_by_profile(ix, items, fresh, attribute, k)
    return existing.withColumn("origin", F.lit("full")).unionByName(added.withColumn("origin", F.lit("update")))
