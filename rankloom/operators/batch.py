"""Batch inference and batch segments: input list to ranked rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from rankloom.operators.filters import include_items
from rankloom.operators.ranking import topk

Scores = DataFrame | Callable[[DataFrame], DataFrame]


def batch_inference(
    inputs: DataFrame, scores: Scores, ix: DataFrame | None = None, types: tuple[str, ...] | None = None, k: int = 25
) -> DataFrame:
    """Top ``k`` items of each input user. With ``ix`` the items are first
    restricted to those the user has interacted with (by ``types`` or any).
    An input without any such item is one row with null item, score and rank.

    ``scores`` is a finished table, or a function that scores the inputs only:
    ``lambda users: affinity(ix, similar, users=users)``.
    """
    return _ranked(inputs, scores, "USER_ID", "ITEM_ID", ix, types, k)


def batch_segment(
    inputs: DataFrame, scores: Scores, ix: DataFrame | None = None, types: tuple[str, ...] | None = None, k: int = 25
) -> DataFrame:
    """Top ``k`` users of each input item, or attribute value if that is what
    ``inputs`` holds. Inputs nobody is close to are one row of nulls each."""
    return _ranked(inputs, scores, inputs.columns[0], "USER_ID", ix, types, k)


def _ranked(inputs, scores, key, id, ix, types, k) -> DataFrame:
    """The item filter runs before the cut to ``k``, so no list comes up short."""
    asked = inputs.select(key).distinct()
    wanted = scores(asked) if callable(scores) else scores.join(asked, key, "left_semi")
    if ix is not None:
        wanted = include_items(wanted, ix, types)
    best = topk(wanted, k, by=[key], id=id).select(key, id, "score", "rank")
    return asked.join(best, key, "left").select(key, id, "score", "rank")
