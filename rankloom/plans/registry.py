"""Registered queries, each next to the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankloom.session import materialise

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}
_trained: dict[tuple[str, str, str], DataFrame] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without SQL only its rows are counted."""

    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return run

    return add


def trained(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A model table, built and written once per session and then served.

    As with any trained version, queries that rank with it read the stored
    table instead of training again.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _trained:
        _trained[key] = materialise(build(), name)
    return _trained[key]
