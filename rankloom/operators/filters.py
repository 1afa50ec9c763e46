"""Row filters: which interactions train, which items may be returned."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A run in one of these states counts as done or under way.
STATUS_CREATING = ("ACTIVE", "CREATE PENDING", "CREATE IN_PROGRESS")


def training_events(ix: DataFrame, event_type: str) -> DataFrame:
    """Interactions of one event type; the test reaches the scan."""
    return ix.where(F.col("EVENT_TYPE") == event_type)


def include_items(candidates: DataFrame, ix: DataFrame, types: Iterable[str] | None = None) -> DataFrame:
    """Candidate (user, item) rows where that user has an interaction with that
    item, of one of ``types`` if given, of any type otherwise.

    Case matters in event types. The right side is cut to distinct keys first,
    so a hot (user, item) pair is one row by the time it is shuffled.
    """
    wanted = ix if types is None else ix.where(F.col("EVENT_TYPE").isin(*types))
    keys = wanted.select("USER_ID", "ITEM_ID").distinct()
    return candidates.join(keys, ["USER_ID", "ITEM_ID"], "left_semi")


def status_in(df: DataFrame, statuses: Iterable[str] = STATUS_CREATING, column: str = "status") -> DataFrame:
    return df.where(F.col(column).isin(*statuses))


def same_text(a: Column, b: Column) -> Column:
    """Equal without regard to case, as dataset-type names compare."""
    return F.upper(a) == F.upper(b)


def changed_since(
    df: DataFrame,
    cutoff: Column | None,
    created: str = "created",
    last_updated: str = "last_updated",
    status: str = "status",
    update: str = "latest_update",
) -> DataFrame:
    """Rows that are created, ACTIVE, and updated strictly after ``cutoff``.

    ``update`` names a struct column with its own created, last_updated and
    status; where it is present its times win and it must be ACTIVE too.
    Without a cutoff no row qualifies.
    """
    if cutoff is None:
        return df.where(F.lit(False))
    nested = update in df.columns

    def effective(outer: str, inner: str) -> Column:
        return F.coalesce(F.col(f"{update}.{inner}"), F.col(outer)) if nested else F.col(outer)

    stable = F.col(status) == "ACTIVE"
    if nested:
        stable = stable & (F.col(update).isNull() | F.col(f"{update}.status").eqNullSafe(F.lit("ACTIVE")))
    return df.where(
        effective(created, "created").isNotNull() & stable & (effective(last_updated, "last_updated") > cutoff)
    )


def update_supported(
    df: DataFrame, incremental: Iterable[str], recipe: str = "recipe", update: str = "update_schedule"
) -> DataFrame:
    """Rows whose recipe cannot take the incremental update they ask for: none
    of the ``incremental`` names is part of it."""
    asks = F.coalesce(F.col(update), F.lit("")) != ""
    able = F.lit(False)
    for name in incremental:
        able = able | F.coalesce(F.contains(F.col(recipe), F.lit(name)), F.lit(False))
    return df.where(asks & ~able)
