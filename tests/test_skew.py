"""Joins must stay splittable when one key holds a third of all rows.

Spark splits a hot partition only where both sides of the join are plain
shuffles. With small limits that shows on small data.
"""

from __future__ import annotations

import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rankloom.operators import neighbours
from rankloom.operators.aggregates import fingerprint, nest_children
from rankloom.operators.coldstart import cold_items
from rankloom.operators.ranking import topk
from rankloom.operators.relations import enrich, ownership
from rankloom.session import materialise, scratch

SMALL_LIMITS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
}


@pytest.fixture
def small_limits(spark):
    before = {name: spark.conf.get(name, None) for name in SMALL_LIMITS}
    for name, value in SMALL_LIMITS.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.fixture
def hot_item(spark):
    """60,000 rows; item 7 was chosen by a third of the users."""
    rows = spark.range(0, 60000, 1, 8)
    item = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 997 + 10)
    return materialise(rows.select(F.col("id").alias("USER_ID"), item.alias("ITEM_ID")), "hot")


def final_plan(df):
    count = len(df.collect())
    return count, df._jdf.queryExecution().executedPlan().toString()


def test_counting_users_per_item(spark, small_limits, hot_item):
    count, plan = final_plan(neighbours._with_item_counts(hot_item))
    assert count == 60000 and "skew=true" in plan


def test_scores_from_neighbours(spark, small_limits, hot_item):
    near = spark.range(2000).select(
        F.col("id").alias("ITEM_ID"), (F.col("id") + 1).alias("SIMILAR_ID"), F.lit(0.5).alias("score")
    )
    count, plan = final_plan(neighbours._contributions(hot_item, materialise(near, "near")))
    assert count == 60000 and "skew=true" in plan


def test_enrichment(spark, small_limits, hot_item):
    items = materialise(spark.range(2000).select(F.col("id").alias("ITEM_ID"), F.lit("x").alias("TYPE")), "items")
    users = materialise(spark.range(60000).select(F.col("id").alias("USER_ID"), F.lit("y").alias("SEGMENT")), "users")
    count, plan = final_plan(enrich(hot_item, items, users))
    assert count == 60000 and "skew=true" in plan


def test_children_of_a_hot_parent(spark, small_limits, hot_item):
    """The numbering spreads a parent over ranges, so no part and no window holds all of it."""
    rows = nest_children(hot_item, "ITEM_ID", ["USER_ID"], 500).collect()
    assert sum(len(r.children) for r in rows) == 60000
    assert max(len(r.children) for r in rows) == 500
    assert all(r.first == 500 * r.part for r in rows)


@pytest.mark.parametrize("k", [3, 5000])
def test_top_k_of_any_depth_is_cut_before_the_groups_meet(spark, hot_item, k):
    scored = hot_item.withColumn("score", F.pmod(F.hash("USER_ID"), F.lit(1000)))
    ranked = topk(scored, k, ["ITEM_ID"], id="USER_ID")
    cuts = ranked._jdf.queryExecution().executedPlan().toString().count("row_number")
    assert cuts >= 2
    got = ranked.groupBy("ITEM_ID").agg(F.count("*").alias("n"), F.max("rank").alias("r"), F.sum("score").alias("s"))
    whole = Window.partitionBy("ITEM_ID").orderBy(F.col("score").desc(), "USER_ID")
    want = scored.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)
    want = want.groupBy("ITEM_ID").agg(F.count("*").alias("n"), F.max("rank").alias("r"), F.sum("score").alias("s"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_descendants_of_a_hot_parent(spark, small_limits, hot_item):
    edges = hot_item.select(
        F.concat(F.lit("i/"), F.col("ITEM_ID").cast("string")).alias("parent"),
        F.concat(F.lit("u/"), F.col("USER_ID").cast("string")).alias("child"),
    )
    roots = materialise(edges.select(F.col("parent").alias("key")).distinct(), "roots")
    count, plan = final_plan(ownership(edges, roots, depth=1))
    assert count == 60000 and "skew=true" in plan


def test_cold_items_with_a_common_value(spark, small_limits, hot_item):
    kinds = F.when(F.col("id") == 7, "hot").when(F.col("id") < 5000, F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).otherwise("hot")
    items = materialise(spark.range(5100).select(F.col("id").alias("ITEM_ID"), kinds.alias("KIND")), "items")
    lists = cold_items(hot_item, items, "KIND", 3)
    rows = [r for r in lists.collect() if r.USER_ID == 0]
    assert [(r.ITEM_ID, r.score, r["rank"]) for r in rows] == [(5000, 1, 1), (5001, 1, 2), (5002, 1, 3)]


def test_fingerprint_does_not_overflow(spark):
    many = spark.range(10).select(F.col("id"))
    row = fingerprint(many, ["id"]).first()
    assert row.row_count == 10 and 0 < row.checksum < 1 << 62


def test_scratch_tables_are_deleted(spark, tmp_path):
    with scratch(spark):
        df = materialise(spark.range(5), "gone")
        path = df.inputFiles()[0].removeprefix("file:")
        df.write.parquet(str(tmp_path / "kept"))
        assert os.path.exists(path)
    assert not os.path.exists(path)
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 5
