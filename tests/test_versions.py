from __future__ import annotations

import threading
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from rankloom.operators import versions
from rankloom.operators.training import retrain_full
from rankloom.session import fresh_path
from rankloom.sources import commits, snapshots
from rankloom.sources.snapshots import commit_log, full_import, read_snapshot, write_version

COMPARE = ["schedule", "payload"]


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), "name string, schedule string, payload string")


def rows(df):
    return sorted(((r.name, r.version, r.schedule, r.payload, r.latest) for r in df.collect()), key=str)


def test_repeated_write_changes_nothing(spark):
    table = versions.first_versions(batch(spark, ("t", "cron", "p")), "name", COMPARE)
    again = versions.versioned_upsert(table, batch(spark, ("t", "cron", "p")), "name", COMPARE)
    assert rows(again) == rows(table) == [("t", 0, "cron", "p", 1), ("t", 1, "cron", "p", None)]


def test_changed_new_and_null_values(spark):
    table = versions.first_versions(batch(spark, ("a", "c", "p"), ("b", "c", None)), "name", COMPARE)
    table = versions.versioned_upsert(table, batch(spark, ("a", "c", "q"), ("b", "c", None), ("n", "c", "p")), "name", COMPARE)
    assert rows(table) == [
        ("a", 0, "c", "q", 2), ("a", 1, "c", "p", None), ("a", 2, "c", "q", None),
        ("b", 0, "c", None, 1), ("b", 1, "c", None, None),
        ("n", 0, "c", "p", 1), ("n", 1, "c", "p", None),
    ]
    assert [r.payload for r in versions.read_version(table, 0, batch(spark, ("a", "", "")).select("name")).collect()] == ["q"]
    assert [r.name for r in versions.read_version(table, 2).collect()] == ["a"]
    assert {r.name: r.next_version for r in versions.next_version(table, "name").collect()} == {"a": 3, "b": 2, "n": 2}


def test_delete_marker_removes_all_versions(spark):
    table = versions.first_versions(batch(spark, ("a", "c", "p"), ("b", "c", "p")), "name", COMPARE)
    table = versions.versioned_upsert(table, batch(spark, ("a", "delete", "")), "name", COMPARE, marker="schedule")
    assert {r.name for r in table.collect()} == {"b"}


def test_pointer_to_another_solution_fails(spark):
    results = spark.createDataFrame([("s", 1, 10), ("s", 2, 11)], "solution string, version long, ITEM_ID long")
    good = spark.createDataFrame([("c", "s", "s/2")], "name string, solution string, version_key string")
    assert [r.ITEM_ID for r in versions.serve_current(results, good).collect()] == [11]
    bad = spark.createDataFrame([("c", "s", "other/2")], "name string, solution string, version_key string")
    with pytest.raises(Exception, match="must serve s, not other"):
        versions.serve_current(results, bad).collect()


def test_pointer_to_an_absent_version_fails(spark):
    results = spark.createDataFrame([("s", 1, 10)], "solution string, version long, ITEM_ID long")
    absent = spark.createDataFrame([("c", "s", "s/7")], "name string, solution string, version_key string")
    with pytest.raises(Exception, match="without results"):
        versions.serve_current(results, absent).collect()


def test_every_change_of_a_key_in_one_batch_is_a_version(spark):
    table = versions.first_versions(batch(spark, ("a", "c", "p")), "name", COMPARE)
    order = "name string, schedule string, payload string, at long"
    changes = [("a", "c", "p", 1), ("a", "c", "q", 2), ("a", "c", "q", 3), ("a", "c", "p", 4), ("n", "c", "x", 5), ("n", "c", "y", 4)]
    more = spark.createDataFrame(changes, order)
    got = versions.versioned_upsert(table, more, "name", COMPARE, arrival=["at"])
    assert rows(got) == [
        ("a", 0, "c", "p", 3), ("a", 1, "c", "p", None), ("a", 2, "c", "q", None), ("a", 3, "c", "p", None),
        ("n", 0, "c", "x", 2), ("n", 1, "c", "y", None), ("n", 2, "c", "x", None),
    ]
    with pytest.raises(Exception, match="two rows without an order"):
        versions.versioned_upsert(table, more, "name", COMPARE).collect()


def test_a_version_is_committed_once(spark):
    root = fresh_path(spark, "snapshots")
    assert write_version(spark.range(3), root, "t", after=0) == 1
    with pytest.raises(ValueError, match="not 0 any more"):
        write_version(spark.range(9), root, "t", after=0)
    assert read_snapshot(spark, root, "t").count() == 3
    with pytest.raises(ValueError, match="no version 7"):
        read_snapshot(spark, root, "t", 7)


def test_one_of_two_writers_between_check_and_commit(spark, monkeypatch):
    root = fresh_path(spark, "snapshots")
    write_version(spark.range(3), root, "t")
    both, results = threading.Barrier(2, timeout=60), []

    def held(session, path, text):
        both.wait()  # both have seen version 1 and written their tables
        return commits.put_if_absent(session, path, text)

    monkeypatch.setattr(snapshots, "put_if_absent", held)

    def write(n):
        try:
            results.append((n, write_version(spark.range(n), root, "t")))
        except ValueError as late:
            results.append((n, str(late)))

    threads = [threading.Thread(target=write, args=(n,)) for n in (5, 7)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    (won,) = [n for n, got in results if got == 2]
    (lost,) = [got for _, got in results if got != 2]
    assert lost == "t is not at version 1 any more"
    assert read_snapshot(spark, root, "t").count() == won
    assert commit_log(spark, root).count() == 2
    assert len(commits.names(spark, f"{root}/t")) == 2  # the loser's table is gone


def test_full_import_replaces_and_keeps_old_snapshot(spark):
    root = fresh_path(spark, "snapshots")
    assert full_import(spark.range(3), root, "items") == 1
    assert full_import(spark.range(5), root, "items") == 2
    assert full_import(spark.range(1), root, "users") == 1
    assert read_snapshot(spark, root, "items").count() == 5
    assert read_snapshot(spark, root, "items", 1).count() == 3
    with pytest.raises(ValueError):
        read_snapshot(spark, root, "interactions")


def test_half_written_version_is_not_seen(spark):
    root = fresh_path(spark, "snapshots")
    full_import(spark.range(3), root, "items")
    spark.range(9).write.parquet(f"{root}/items/version=2")
    assert read_snapshot(spark, root, "items").count() == 3
    assert full_import(spark.range(4), root, "items") == 2
    assert read_snapshot(spark, root, "items").count() == 4


def test_retraining_waits_for_age(spark):
    root = fresh_path(spark, "solutions")
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)

    def train(**more):
        return retrain_full(spark.range(3), lambda ix: ix.withColumn("score", F.lit(1)), root, "s", **more)

    assert train(now=start) == 1
    assert train(now=start) is None
    assert train(max_age=86400, now=start + timedelta(hours=1)) is None
    assert train(max_age=86400, now=start + timedelta(days=2)) == 2
    assert train(force=True, now=start) == 3
    assert commit_log(spark, root).count() == 3
