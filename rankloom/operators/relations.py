"""Joins and set operations on keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.documents import same_json
from rankloom.session import materialise


def enrich(ix: DataFrame, items: DataFrame, users: DataFrame) -> DataFrame:
    """Interactions with item and user attributes; rows without a match stay.

    No hint is given: Spark broadcasts a side it measures as small, otherwise
    merges, and AQE splits a hot item or user.
    """
    return ix.join(items, "ITEM_ID", "left").join(users, "USER_ID", "left")


def union_keys(a: DataFrame, b: DataFrame, name: str = "key") -> DataFrame:
    """Distinct union of two one-column key sets."""
    return a.toDF(name).unionByName(b.toDF(name)).distinct()


def except_keys(df: DataFrame, allowed: DataFrame) -> DataFrame:
    """Distinct keys of ``df`` that are not allowed."""
    return df.subtract(allowed)


def available_keys(candidates: DataFrame, edges: DataFrame, key: str = "key") -> DataFrame:
    """Candidates that occur nowhere, neither as a key nor as an owner."""
    taken = union_keys(edges.select("child"), edges.select("owner"), key)
    return candidates.join(taken, key, "left_anti")


def ownership(edges: DataFrame, roots: DataFrame, kinds: list[str] | None = None, depth: int | None = None) -> DataFrame:
    """The owner (root) of every descendant: owner, child, level.

    With ``kinds`` (the parent kind of each level, top down) every level reads
    only its own edges; with ``depth`` all edges may occur on every level.
    Use ``ownership_any_depth`` when neither is known.
    """
    levels = [edges.where(F.col("parent_kind") == kind) for kind in kinds] if kinds else [edges] * (depth or 1)
    owned = roots.select(F.col("key").alias("owner"), F.col("key").alias("parent"))
    found = []
    for level, below in enumerate(levels, start=1):
        step = owned.join(below.select("parent", "child"), "parent").select("owner", "child")
        found.append(step.withColumn("level", F.lit(level).cast("long")))
        owned = step.withColumnRenamed("child", "parent")
    return reduce(DataFrame.unionByName, found)


def ownership_any_depth(edges: DataFrame) -> DataFrame:
    """The top owner of every child, for trees of unknown depth: owner, child.

    Each round lets a row look up its owner's owner, so the steps covered double
    and a tree of depth d takes about log2(d) rounds. Rows that have arrived are
    written once and only looked up from then on. Every round is written to the
    shared folder, so a lost executor costs one round at most. A row that comes
    back to itself, or moves for longer than any tree of so many edges allows,
    is on a cycle, which is an error.
    """
    active = materialise(edges.select(F.col("parent").alias("owner"), "child"), "owners")
    arrived: list[DataFrame] = []
    for _ in range(active.count().bit_length() + 1):
        above = reduce(DataFrame.unionByName, [*arrived, active])
        above = above.select(F.col("child").alias("owner"), F.col("owner").alias("higher"))
        doubled = active.join(above, "owner", "left").select(
            F.coalesce("higher", "owner").alias("owner"), "child", F.col("higher").isNotNull().alias("moved")
        )
        doubled = materialise(doubled, "owners")
        arrived.append(doubled.where("NOT moved").select("owner", "child"))
        active = doubled.where("moved").select("owner", "child")
        if active.isEmpty():
            return reduce(DataFrame.unionByName, arrived)
        if not active.where("owner = child").isEmpty():
            break
    raise ValueError("the edges hold a cycle")


def owned_by(candidates: DataFrame, owners: DataFrame, owner: str) -> DataFrame:
    """Candidates (child) that belong to ``owner``."""
    return candidates.join(owners.where(F.col("owner") == owner).select("child"), "child", "left_semi")


def reconcile(
    expected: DataFrame,
    actual: DataFrame,
    key: str,
    ignore: tuple[str, ...] = (),
    case_blind: tuple[str, ...] = (),
    as_json: dict[str, str] | None = None,
) -> DataFrame:
    """Keys whose rows differ: key, side, mismatches (column names by comma).

    ``side`` is ``both``, ``missing`` (expected only) or ``unexpected``.
    ``as_json`` maps a column to the schema its text is compared by.
    """
    as_json = as_json or {}
    compared = [c for c in expected.columns if c != key and c not in ignore]

    def same(column: str) -> Column:
        want, got = F.col(f"e.{column}"), F.col(f"a.{column}")
        if column in as_json:
            return same_json(want, got, as_json[column])
        if column in case_blind:
            return F.lower(want).eqNullSafe(F.lower(got))
        return want.eqNullSafe(got)

    left = expected.select(key, *compared, F.lit(True).alias("here")).alias("e")
    right = actual.select(key, *compared, F.lit(True).alias("here")).alias("a")
    joined = left.join(right, F.col(f"e.{key}") == F.col(f"a.{key}"), "full_outer")
    side = (
        F.when(F.col("a.here").isNull(), "missing").when(F.col("e.here").isNull(), "unexpected").otherwise("both")
    )
    differing = F.array_compact(F.array(*[F.when(~same(c), F.lit(c)) for c in compared]))
    return joined.select(
        F.coalesce(f"e.{key}", f"a.{key}").alias(key),
        side.alias("side"),
        F.array_join(differing, ",").alias("mismatches"),
    ).where((F.col("side") != "both") | (F.col("mismatches") != ""))
