"""Missing values, inherited attributes, and columns fit to publish."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OMIT = "omit"

# System columns that are never published, and the one kept.
SYSTEM_COLUMNS = (
    "status", "creationDateTime", "lastUpdatedDateTime", "accountId", "trackingId", "datasetType",
    "latestSolutionVersion", "latestCampaignUpdate", "failureReason", "jobInput", "jobOutput", "jobName",
    "roleArn", "solutionVersionArn",
)
KEPT_COLUMN = "recipeArn"
SYSTEM_SUFFIX = "Arn"


def falsy(column: str, kind: T.DataType) -> Column:
    """Null, empty text, zero, false or an empty list."""
    value = F.col(column)
    if isinstance(kind, T.StringType):
        empty = value == ""
    elif isinstance(kind, T.BooleanType):
        empty = ~value
    elif isinstance(kind, T.NumericType):
        empty = value == 0
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        empty = F.size(value) == 0
    else:
        empty = F.lit(False)
    return value.isNull() | empty


def fill_defaults(df: DataFrame, defaults: dict[str, Any], mode: str = "resolve") -> DataFrame:
    """Fill missing values.

    ``resolve``: every falsy value is missing; the default ``omit`` leaves
    null, the default ``None`` makes a missing value an error. ``absent``: only
    null is missing.
    """
    filled = {}
    for name, default in defaults.items():
        kind = df.schema[name].dataType
        missing = falsy(name, kind) if mode == "resolve" else F.col(name).isNull()
        if default is None and mode == "resolve":
            instead = F.raise_error(F.lit(f"missing configuration for {name}"))
        elif default is None or default == OMIT:
            instead = F.lit(None)
        else:
            instead = F.lit(default)
        filled[name] = F.when(missing, instead.cast(kind)).otherwise(F.col(name))
    return df.withColumns(filled)


def inherit_attributes(child: DataFrame, parent: DataFrame, on: str, column: str) -> DataFrame:
    """A child without the attribute takes its parent's, else an empty list.

    Only an absent attribute is inherited; an empty one is the child's own.
    """
    kind = child.schema[column].dataType
    above = parent.select(on, F.col(column).alias("_inherited"))
    value = F.coalesce(F.col(column), F.col("_inherited"), F.array().cast(kind))
    return child.join(above, on, "left").withColumn(column, value).drop("_inherited")


def public_columns(df: DataFrame, keep: str = KEPT_COLUMN, drop: tuple[str, ...] = SYSTEM_COLUMNS) -> DataFrame:
    """Without system columns: the listed ones and all named ``...Arn`` but one."""
    return df.select([c for c in df.columns if c == keep or not (c in drop or c.endswith(SYSTEM_SUFFIX))])
