"""Key and label columns: case styles, path parts, run labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What makes a valid key name, and the longest accepted label.
VALID_NAME = "^[a-z][A-Za-z]*$"
LABEL_LIMIT = 63


def _split_capitals(name: Column, mark: str) -> Column:
    marked = F.lower(F.regexp_replace(name, "([A-Z])", f"{mark}$1"))
    return F.regexp_replace(marked, f"^{mark}+", "")


def camel_to_snake(name: Column) -> Column:
    return _split_capitals(name, "_")


def camel_to_dash(name: Column) -> Column:
    return _split_capitals(name, "-")


def snake_to_camel(name: Column) -> Column:
    words = F.split(name, "_")
    rest = F.transform(F.slice(words, 2, F.size(words)), lambda word: F.initcap(word))
    return F.concat(F.element_at(words, 1), F.array_join(rest, ""))


def key_parent(key: Column) -> Column:
    """Everything before the last ``/``; null for a key without one."""
    return F.when(F.contains(key, F.lit("/")), F.regexp_replace(key, "/[^/]*$", ""))


def key_last(key: Column) -> Column:
    return F.substring_index(key, "/", -1)


def compose_key(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def normalise_keys(df: DataFrame, column: str) -> DataFrame:
    """Adds parent, last, snake, dash, camel and valid for a key column."""
    key = F.col(column)
    camel = snake_to_camel(key_last(key))
    return df.withColumns(
        {
            "parent": key_parent(key),
            "last": key_last(key),
            "camel": camel,
            "snake": camel_to_snake(camel),
            "dash": camel_to_dash(camel),
            "valid": camel.rlike(VALID_NAME),
        }
    )


def run_label(df: DataFrame, name: str, ts: str) -> DataFrame:
    """Adds ``label`` (batch_<name>_YYYY_MM_DD_HH_MM_SS) and ``too_long``."""
    label = F.concat_ws("_", F.lit("batch"), F.col(name), F.date_format(ts, "yyyy_MM_dd_HH_mm_ss"))
    return df.withColumn("label", label).withColumn("too_long", F.length("label") > LABEL_LIMIT)
