"""Expected values for single rules."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rankloom.functions import defaults, documents, names, times
from rankloom.operators.aggregates import dataset_rules, fingerprint, nest_children, well_formed_tags
from rankloom.operators.coldstart import update_new_items
from rankloom.operators.filters import changed_since, update_supported
from rankloom.operators.ranking import latest_per_parent
from rankloom.operators.relations import ownership, ownership_any_depth, reconcile
from rankloom.operators.runlog import freshness_gate


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "text, seconds",
    [
        ("3 hours", 10800), ("90 min", 5400), ("twelve minutes", 720), ("2.5 hrs", 9000), ("an hour 15 sec", 3615),
        ("six weeks", 3628800), ("three months", 7776000), ("1.5 weeks", 907200), ("4 years", 126230400),
        ("1 Week, 2 Days", 777600), ("week", None), ("later", None), ("", None), (None, None),
    ],
)
def test_duration(spark, text, seconds):
    assert one(spark, text, times.duration_seconds) == seconds


@pytest.mark.parametrize(
    "camel, dash, snake",
    [
        ("orderLine", "order-line", "order_line"), ("part", "part", "part"), ("shipToAddress", "ship-to-address", "ship_to_address"),
        ("aVeryLongColumnName", "a-very-long-column-name", "a_very_long_column_name"), ("priceInEuro", "price-in-euro", "price_in_euro"),
    ],
)
def test_names(spark, camel, dash, snake):
    assert one(spark, camel, names.camel_to_dash) == dash
    assert one(spark, camel, names.camel_to_snake) == snake
    assert one(spark, snake, names.snake_to_camel) == camel


@pytest.mark.parametrize("key, parent, last", [("a/b/c", "a/b", "c"), ("a", None, "a")])
def test_key_parts(spark, key, parent, last):
    assert one(spark, key, names.key_parent) == parent
    assert one(spark, key, names.key_last) == last


NOW = datetime(2002, 1, 1)
DAY = 86400


@pytest.mark.parametrize(
    "status, age_days, max_age, data_age_days, old_name, new_name, current",
    [
        ("ACTIVE", 1, None, None, "a", "b", True),
        ("CREATE PENDING", 1, None, None, "a", "b", True),
        ("FAILED", 1, None, None, "a", "b", False),
        ("FAILED", 1, DAY, None, "a", "a", True),
        ("ACTIVE", 2, DAY, None, "a", "b", False),
        ("ACTIVE", 1 + 0.5 / DAY, DAY, None, "a", "b", False),
        ("ACTIVE", 1 - 0.5 / DAY, DAY, None, "a", "b", True),
        ("ACTIVE", 2, DAY, 1, "a", "b", False),
        ("ACTIVE", 2, DAY, 3, "a", "b", True),
        ("ACTIVE", 1, DAY, 0, "a", "b", True),
        ("ACTIVE", 9, 0, 0, "a", "b", True),
        ("CREATE IN_PROGRESS", 9, DAY, 0, "a", "b", True),
        (None, None, DAY, None, "a", "b", False),
    ],
)
def test_freshness(spark, status, age_days, max_age, data_age_days, old_name, new_name, current):
    runs = [] if status is None else [(1, status, NOW - timedelta(days=age_days), old_name)]
    data = None if data_age_days is None else NOW - timedelta(days=data_age_days)
    runs = spark.createDataFrame(runs, "parent long, status string, last_updated timestamp, name string")
    asked = spark.createDataFrame([(1, max_age, data, new_name)], "parent long, max_age long, data_time timestamp, name string")
    assert freshness_gate(runs, asked, F.lit(NOW)).first().is_current is current


@pytest.mark.parametrize(
    "created, updated, status, nested, stable",
    [
        (None, None, None, None, False),
        (NOW, NOW, None, None, False),
        (NOW, NOW, "ACTIVE", None, True),
        (NOW, NOW, "ACTIVE", (NOW, NOW, "UPDATING"), False),
        (NOW, NOW, "ACTIVE", (NOW, NOW, "ACTIVE"), True),
        (NOW, NOW, "ACTIVE", (NOW, NOW - timedelta(days=9), "ACTIVE"), False),
        (NOW, NOW - timedelta(seconds=100), "ACTIVE", None, False),
        (None, NOW, "ACTIVE", None, False),
    ],
)
def test_stability(spark, created, updated, status, nested, stable):
    schema = "created timestamp, last_updated timestamp, status string, latest_update struct<created timestamp, last_updated timestamp, status string>"
    df = spark.createDataFrame([(created, updated, status, nested)], schema)
    cutoff = F.lit(NOW - timedelta(seconds=100))
    assert (changed_since(df, cutoff).count() == 1) is stable
    assert changed_since(df, None).count() == 0


def test_resolve_fills_falsy_and_absent_fills_null(spark):
    df = spark.createDataFrame(
        [("", 0, False, []), (None, None, None, None), ("x", 2, True, ["t"])], "s string, n long, b boolean, l array<string>"
    )
    filled = defaults.fill_defaults(df, {"s": "d", "n": 7, "b": True})
    assert [tuple(r)[:3] for r in filled.collect()] == [("d", 7, True), ("d", 7, True), ("x", 2, True)]
    kept = defaults.fill_defaults(df, {"s": "d", "n": 7, "b": True}, mode="absent")
    assert [tuple(r)[:3] for r in kept.collect()] == [("", 0, False), ("d", 7, True), ("x", 2, True)]
    omitted = defaults.fill_defaults(df, {"s": "omit"})
    assert [r.s for r in omitted.collect()] == [None, None, "x"]
    with pytest.raises(Exception, match="missing configuration for s"):
        defaults.fill_defaults(df, {"s": None}).collect()


def test_only_absent_attributes_are_inherited(spark):
    child = spark.createDataFrame([(1, 1, None), (2, 1, []), (3, 1, ["own"]), (4, 9, None)], "id long, p long, tags array<string>")
    parent = spark.createDataFrame([(1, ["root"])], "p long, tags array<string>")
    got = {r.id: r.tags for r in defaults.inherit_attributes(child, parent, "p", "tags").collect()}
    assert got == {1: ["root"], 2: [], 3: ["own"], 4: []}


def test_public_columns(spark):
    df = spark.createDataFrame([(1, 2, 3, 4, 5)], "name int, solutionArn int, recipeArn int, status int, failureReason int")
    assert defaults.public_columns(df).columns == ["name", "recipeArn"]


def test_json_lists_and_keys(spark):
    text = '{"solutions":[{"name":"a","campaigns":[{"name":"x"},{"name":"y"}]},{"name":"b","odd":1}],"tags":[],"zzz":0}'
    assert one(spark, text, lambda c: documents.json_list(c, "$.solutions[*].name")) == ["a", "b"]
    assert one(spark, text, lambda c: documents.json_list(c, "$.solutions[*].campaigns[*].name")) == ["x", "y"]
    assert one(spark, text, lambda c: documents.json_list(c, "$.absent[*].name")) == []
    only_b = documents.json_list(F.col("v"), "$.solutions[*].name", lambda e: F.get_json_object(e, "$.name") == "b")
    assert one(spark, text, lambda c: only_b) == ["b"]
    allowed = {"solutions": [{"name": None, "campaigns": [{"name": None}]}], "tags": None}
    assert one(spark, text, lambda c: documents.bad_keys(c, allowed)) == ["zzz", "solutions[1].odd"]


def test_json_equality_ignores_order(spark):
    df = spark.createDataFrame([('{"a":1,"b":"x"}', '{ "b": "x", "a": 1 }', '{"a":2,"b":"x"}')], "x string, y string, z string")
    schema = "a long, b string"
    row = df.select(
        documents.same_json(F.col("x"), F.col("y"), schema).alias("same"), documents.same_json(F.col("x"), F.col("z"), schema).alias("other")
    ).first()
    assert (row.same, row.other) == (True, False)


@pytest.mark.parametrize(
    "tags, ok",
    [
        ('[{"tagKey":"a","tagValue":"b"}]', True), ("[]", True), ('[{"tagKey":"a"}]', False),
        ('[{"tagKey":"a","tagValue":"b","x":1}]', False), ('["a"]', False), ("nonsense", False), (None, False),
    ],
)
def test_tags(spark, tags, ok):
    df = spark.createDataFrame([(tags,)], "tags string")
    assert df.select(well_formed_tags("tags")).first()[0] is ok


def test_rules_report_everything_and_empty_tables(spark):
    empty = spark.createDataFrame([], "USER_ID long")
    users = spark.createDataFrame([(1,), (None,)], "USER_ID long")
    missing = F.col("USER_ID").isNull()
    got = dataset_rules({"interactions": empty, "users": users}, [("interactions", "key", missing), ("users", "key", missing)])
    assert sorted(tuple(r) for r in got.collect()) == [
        ("interactions", "key", 0), ("interactions", "not_empty", 1), ("users", "key", 1),
    ]


def test_update_support(spark):
    rows = [("valid", "user-personalization", "cron"), ("valid", "sims", None), ("valid", "hrnn-coldstart", "cron"), ("invalid", "sims", "cron")]
    df = spark.createDataFrame(rows, "name string, recipe string, update_schedule string")
    assert [r.name for r in update_supported(df, ("hrnn-coldstart", "user-personalization")).collect()] == ["invalid"]


def test_newest_child_and_missing_parent(spark):
    runs = spark.createDataFrame(
        [(1, 5, NOW, "ACTIVE"), (1, 4, NOW, "ACTIVE"), (1, 6, NOW + timedelta(1), "FAILED"), (2, 7, NOW, "FAILED")],
        "parent long, id long, created timestamp, status string",
    )
    parents = spark.createDataFrame([(1,), (2,), (3,)], "parent long")
    got = latest_per_parent(runs, parents, "parent", "created", "id", F.col("status") == "ACTIVE")
    assert sorted((r.parent, r.id, r.found) for r in got.collect()) == [(1, 4, True), (2, None, False), (3, None, False)]


def test_reconcile_sides_and_ignored_columns(spark):
    schema = "id long, kind string, doc string, tags string"
    want = spark.createDataFrame([(1, "Items", '{"a":1}', "x"), (2, "u", '{"a":1}', "x"), (3, None, None, None), (4, "k", None, None)], schema)
    got = spark.createDataFrame([(1, "ITEMS", '{ "a":1 }', "y"), (2, "v", '{"a":2}', "x"), (3, None, None, "z"), (5, "k", None, None)], schema)
    out = reconcile(want, got, "id", ignore=("tags",), case_blind=("kind",), as_json={"doc": "a long"})
    assert sorted(tuple(r) for r in out.collect()) == [(2, "both", "kind,doc"), (4, "missing", "kind"), (5, "unexpected", "kind")]


def test_ownership_by_depth_and_without(spark):
    edges = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "c"), ("c", "d"), ("s", "e")], "parent string, child string")
    roots = spark.createDataFrame([("r",), ("s",)], "key string")
    want = [("r", "a"), ("r", "b"), ("r", "c"), ("r", "d"), ("s", "e")]
    assert sorted((r.owner, r.child) for r in ownership(edges, roots, depth=4).collect()) == want
    assert sorted(tuple(r) for r in ownership_any_depth(edges).collect()) == want
    for ring in (["a", "b"], ["a", "b", "c"]):
        cycle = spark.createDataFrame(list(zip(ring, ring[1:] + ring[:1])), "parent string, child string")
        with pytest.raises(ValueError, match="cycle"):
            ownership_any_depth(cycle)


def test_hot_parent_is_spread_but_whole(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("parent"), F.col("id").alias("child"))
    nested = nest_children(df, "parent", ["child"], part_size=50).collect()
    hot = sorted((r for r in nested if r.parent == 0), key=lambda r: r.part)
    assert [r.first for r in hot] == [0, 50, 100, 150, 200, 250, 300, 350]
    assert [c.child for r in hot for c in r.children] == list(range(400))
    assert all(r.part == 0 and len(r.children) == 1 for r in nested if r.parent != 0)


def test_fingerprint_sees_content_and_not_order(spark):
    df = spark.range(100).withColumn("t", F.col("id").cast("string"))
    first = fingerprint(df, ["id", "t"]).first()
    assert first == fingerprint(df.orderBy(F.col("id").desc()).repartition(7), ["id", "t"]).first()
    assert first != fingerprint(df.where("id <> 5"), ["id", "t"]).first()


def test_fingerprint_sees_moved_values(spark):
    schema = "a string, b string, c string"
    rows = [("a", None, "b"), ("a", "b", None), ("a|b", "", None), ("a", "|b", None), (None, "a", "b"), ("", "a", "b")]
    sums = {fingerprint(spark.createDataFrame([r], schema), ["a", "b", "c"]).first().checksum for r in rows}
    assert len(sums) == len(rows)


def test_update_with_new_interactions_only(spark):
    items = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "ITEM_ID long, kind string")
    old = spark.createDataFrame([(7, 1), (8, 3)], "USER_ID long, ITEM_ID long")
    new = old.unionByName(spark.createDataFrame([(8, 2)], "USER_ID long, ITEM_ID long"))
    existing = spark.createDataFrame([(7, 1, 1, 1)], "USER_ID long, ITEM_ID long, score long, rank long")
    got = update_new_items(existing, items, new, items, "kind", versioned_ix=old).collect()
    assert {(r.USER_ID, r.ITEM_ID) for r in got if r.origin == "update"} == {(7, 2), (8, 2)}
    with pytest.raises(ValueError, match="nothing was added"):
        update_new_items(existing, items, old, items, "kind", versioned_ix=old)
