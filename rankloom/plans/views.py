"""Canonical views: the test tables in the roles of interactions, users, items,
run log and ownership edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.session import prepare

EVENTS_CUTOFF = "2024-01-25 00:00:00"
ORDERS_CUTOFF = "2000-07-01 00:00:00"
COLD_CUTOFF = "1996-01-01 00:00:00"
NOW = "2002-01-01 00:00:00"


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def epoch_seconds(ts: str | Column) -> Column:
    """Whole seconds since 1970 of a zone-less timestamp, rounded down."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("SECOND", ntz("1970-01-01 00:00:00"), ts)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ix_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("USER_ID"),
        F.get_json_object("props", "$.k").cast("long").alias("ITEM_ID"),
        F.col("ts").alias("TS"),
        epoch_seconds("ts").alias("TIMESTAMP"),
        F.col("event_type").alias("EVENT_TYPE"),
        F.col("value").alias("EVENT_VALUE"),
    )


def ix_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").alias("USER_ID"),
        F.col("l_partkey").alias("ITEM_ID"),
        F.col("o_orderdate").alias("TS"),
        F.col("l_returnflag").alias("EVENT_TYPE"),
        F.col("l_quantity").alias("EVENT_VALUE"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("USER_ID"),
        F.col("c_mktsegment").alias("SEGMENT"),
        F.col("c_nationkey").cast("long").alias("NATION"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ITEM_ID"),
        F.col("p_type").alias("TYPE"),
        F.col("p_brand").alias("BRAND"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a run log: one run per order, its customer as parent."""
    orders = table(spark, sf_dir, "orders")
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    status = (
        F.when(F.col("o_orderstatus") == "F", "ACTIVE")
        .when(F.col("o_orderstatus") == "O", "CREATE IN_PROGRESS")
        .otherwise("CREATE FAILED")
    )
    return orders.join(shipped, orders.o_orderkey == shipped.l_orderkey, "left").select(
        F.col("o_custkey").alias("parent"),
        F.col("o_orderkey").alias("run_id"),
        status.alias("status"),
        F.col("o_orderdate").alias("created"),
        F.greatest("o_orderdate", F.coalesce("shipped", "o_orderdate")).alias("last_updated"),
        F.col("o_orderpriority").alias("priority"),
    )


def _key(kind: str, column: str) -> Column:
    return F.concat(F.lit(f"{kind}/"), F.col(column).cast("string"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region > nation > customer > order, with the parent's kind as a literal
    so that a filter on it leaves only one branch of the union."""
    levels = [
        ("region", "nation", "nation", "n_regionkey", "n_nationkey"),
        ("nation", "customer", "customer", "c_nationkey", "c_custkey"),
        ("customer", "order", "orders", "o_custkey", "o_orderkey"),
    ]
    parts = [
        table(spark, sf_dir, name).select(
            F.lit(parent).alias("parent_kind"),
            _key(parent, parent_key).alias("parent"),
            _key(child, child_key).alias("child"),
        )
        for parent, child, name, parent_key, child_key in levels
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
