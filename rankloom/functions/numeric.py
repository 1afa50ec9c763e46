"""Numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round6(value: Column) -> Column:
    """Six decimal places, halves up.

    Multiply, add, floor and divide are exact IEEE steps, so any engine gets
    the same double; they also stay primitive inside generated code, where
    ``round`` on doubles builds a decimal object per row.
    """
    return F.floor(value * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)
