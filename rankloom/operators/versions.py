"""Versioned tables: version 0 is the current copy, 1..n the history.

The current copy of a key carries ``latest``, the number of its newest
version. Stored with ``version = 0`` as a partition, an upsert reads only the
current copies and appends to the history without rewriting it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: this word in the marker column removes the key.
DELETE = "delete"


def next_version(history: DataFrame, key: str) -> DataFrame:
    """The number a new version of each key would get."""
    return history.groupBy(key).agg((F.max("version") + 1).alias("next_version"))


def first_versions(batch: DataFrame, key: str, compare: list[str], arrival: list[str] | None = None) -> DataFrame:
    """A versioned table made of one batch: version 1 of each key, and more where it changes."""
    nothing = batch.limit(0).select(
        key, *compare, F.lit(0).cast("long").alias("version"), F.lit(None).cast("long").alias("latest")
    )
    return versioned_upsert(nothing, batch, key, compare, arrival=arrival)


def versioned_upsert(
    history: DataFrame,
    batch: DataFrame,
    key: str,
    compare: list[str],
    marker: str | None = None,
    arrival: list[str] | None = None,
) -> DataFrame:
    """Every change of a key gets the next version, the last one becomes
    current; rows equal to the copy before them write nothing. Rows whose
    ``marker`` column says delete remove their key before the rest is applied.

    ``arrival`` orders the rows of a key in the batch; without it a key may be
    there once only, else it is an error. Only current copies meet the batch.
    """
    if marker is not None:
        history = delete_versions(history, batch.where(F.col(marker) == DELETE).select(key))
        batch = batch.where(~F.col(marker).eqNullSafe(F.lit(DELETE)))
    none = F.lit(None).cast("long")
    order = F.struct(*arrival) if arrival else F.lit(0)
    current = history.where(F.col("version") == 0)
    # The current copy stands before the rows of the batch: place 0, then their arrival.
    old = current.select(key, *compare, "latest", F.lit(0).alias("_new"))
    new = batch.select(key, *compare, none.alias("latest"), F.lit(1).alias("_new"), order.alias("_order"))
    rows = old.withColumn("_order", F.lit(None).cast(new.schema["_order"].dataType)).unionByName(new)
    in_order = Window.partitionBy(key).orderBy("_new", "_order")
    before = {c: F.lag(F.col(c)).over(in_order) for c in compare}
    same = F.lit(True)
    for column in compare:
        same = same & F.col(column).eqNullSafe(F.col(f"_before_{column}"))
    ranked = rows.withColumns({f"_before_{c}": x for c, x in before.items()}).withColumn(
        "_place", F.row_number().over(in_order)
    )
    if not arrival:
        seen = F.count(F.when(F.col("_new") == 1, 1)).over(Window.partitionBy(key))
        twice = F.raise_error(F.concat(F.lit("two rows without an order for "), F.col(key).cast("string"))).cast("int")
        ranked = ranked.withColumn("_place", F.when(seen > 1, twice).otherwise(F.col("_place")))
    changed = (F.col("_new") == 1) & ((F.col("_place") == 1) | ~same)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = ranked.withColumn("_changed", changed).withColumn(
        "_version",
        F.coalesce(F.max("latest").over(so_far), F.lit(0)) + F.sum(F.col("_changed").cast("long")).over(so_far),
    )
    added = numbered.where("_changed").select(key, *compare, F.col("_version").alias("version"), none.alias("latest"))
    whole = F.struct(F.col("_place"), *[F.col(c) for c in compare], F.col("_version"))
    last = numbered.groupBy(key).agg(F.max_by(whole, "_place").alias("_last"))
    heads = last.select(
        key,
        *[F.col(f"_last.{c}").alias(c) for c in compare],
        F.lit(0).cast("long").alias("version"),
        F.col("_last._version").alias("latest"),
    )
    body = history.where(F.col("version") > 0).select(key, *compare, "version", "latest")
    return body.unionByName(added).unionByName(heads)


def read_version(history: DataFrame, version: int = 0, keys: DataFrame | None = None) -> DataFrame:
    """Rows at a version, 0 being the current copy; of the given keys or all."""
    rows = history.where(F.col("version") == version)
    return rows if keys is None else rows.join(keys, keys.columns, "left_semi")


def delete_versions(history: DataFrame, keys: DataFrame) -> DataFrame:
    """Without any version of the given keys."""
    return history.join(keys, keys.columns, "left_anti")


def serve_current(results: DataFrame, pointers: DataFrame) -> DataFrame:
    """Results of the version each name points to.

    ``pointers`` has name, solution and version, where version is the full
    ``solution/number`` key. A version of another solution is an error, and so
    is a version that has no results.
    """
    owner = F.regexp_replace("version_key", "/[^/]*$", "")
    checked = pointers.select(
        "name",
        F.when(owner == F.col("solution"), F.col("solution"))
        .otherwise(F.raise_error(F.concat(F.col("name"), F.lit(" must serve "), F.col("solution"), F.lit(", not "), owner)))
        .alias("solution"),
        F.substring_index("version_key", "/", -1).cast("long").alias("version"),
    )
    served = checked.join(results.withColumn("_found", F.lit(True)), ["solution", "version"], "left")
    absent = F.raise_error(F.concat(F.col("name"), F.lit(" serves a version without results"))).cast("boolean")
    # The test must not be optimised away with an unused column, so it filters.
    return served.where(F.coalesce("_found", absent)).drop("_found")
