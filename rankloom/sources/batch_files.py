"""Batch jobs: JSON lines in, ranked JSON lines out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The record read for each kind of batch input.
INPUT_FIELDS = {"user": ("userId", "USER_ID"), "item": ("itemId", "ITEM_ID")}


def read_batch_input(spark: SparkSession, path: str, kind: str, id_type: str = "string") -> DataFrame:
    """Inputs of a job: ``user``, ``item``, or an attribute's name.

    Records without the field are left out. A repeated input stays; it only
    ever meets a semi-join, where it does no harm.
    """
    field, column = INPUT_FIELDS.get(kind, (kind, kind))
    records = spark.read.schema(f"`{field}` string").json(path)
    wanted = records.select(F.col(field).try_cast(id_type).alias(column))
    return wanted.where(F.col(column).isNotNull())


def write_batch_output(ranked: DataFrame, path: str, key: str, id: str, field: str | None = None) -> None:
    """One JSON record per input: the input and its results, best first.

    ``ranked`` is at most k rows per input, so a record is bounded; an input
    whose only row has a null ``id`` column has an empty list. Spark's
    ``_SUCCESS`` file marks the folder complete.
    """
    batch_records(ranked, key, id, field).write.mode("errorifexists").json(path)


def batch_records(ranked: DataFrame, key: str, id: str, field: str | None = None) -> DataFrame:
    found = F.struct(F.col("rank"), F.col(id).cast("string").alias("id"), F.col("score").cast("double").alias("score"))
    entry = F.when(F.col(id).isNotNull(), found)  # lists leave nulls out
    ordered = F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["id"].alias("id"), e["score"].alias("score")))
    grouped = ranked.groupBy(key).agg(ordered.alias("results"))
    return grouped.select(F.struct(F.col(key).cast("string").alias(field or key)).alias("input"), "results")


def read_batch_output(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Output records as flat rows: key, id, score, rank; nulls for an empty list."""
    schema = f"input struct<`{key}`: string>, results array<struct<id: string, score: double>>"
    records = spark.read.schema(schema).json(path)
    flat = records.select(F.col(f"input.{key}").alias(key), F.posexplode_outer("results").alias("place", "entry"))
    return flat.select(
        key,
        F.col("entry.id").alias("id"),
        F.col("entry.score").alias("score"),
        (F.col("place") + 1).cast("long").alias("rank"),
    )
