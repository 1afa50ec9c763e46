"""The stored versioned table, next to the plan over the whole table."""

from __future__ import annotations

import pathlib
import random

import pytest

from rankloom.operators import versions
from rankloom.session import fresh_path
from rankloom.sources import commits, version_store
from rankloom.sources.version_store import VersionStore

SCHEMA = "key long, payload string, at long"


def shown(df):
    return sorted(tuple(r) for r in df.select("key", "version", "payload", "latest").na.fill(-1).na.fill("null").collect())


def files(store):
    return {str(p.relative_to(store.root)) for p in pathlib.Path(store.root).rglob("part-*.parquet")}


def test_equal_to_the_plan_over_the_whole_table(spark):
    rng = random.Random(5)
    store = VersionStore(spark, fresh_path(spark, "versions"), "key", ["payload"], buckets=5, fanout=2, keep=2)
    with pytest.raises(ValueError, match="nothing has been stored"):
        store.read()
    table = None
    for state in range(1, 8):
        rows = [(rng.randrange(30), rng.choice(["a", "b", None]), at) for at in range(25)]
        if state > 2:
            gone = {rng.randrange(30) for _ in range(2)}
            rows = [r for r in rows if r[0] not in gone] + [(k, versions.DELETE, 0) for k in gone]
        batch = spark.createDataFrame(rows, SCHEMA)
        if table is None:
            table = versions.first_versions(batch, "key", ["payload"], arrival=["at"])
        else:
            table = versions.versioned_upsert(table, batch, "key", ["payload"], marker="payload", arrival=["at"])
        table = spark.createDataFrame(table.collect(), table.schema)
        assert store.upsert(batch, marker="payload", arrival=["at"]) == state
        assert shown(store.read()) == shown(table)
        assert max(len(runs) for runs in store.layout().history.values()) <= 3
    assert shown(store.read(0)) == shown(table.where("version = 0"))
    assert shown(store.read(2)) == shown(table.where("version = 2"))
    keys = spark.createDataFrame([(3,), (999,)], "key long")
    assert shown(store.read(keys=keys)) == shown(table.where("key = 3"))
    assert len(commits.names(spark, f"{store.root}/manifests")) <= 2
    assert store.upsert(batch.limit(0)) == 7


def test_an_upsert_rewrites_its_buckets_only(spark):
    store = VersionStore(spark, fresh_path(spark, "versions"), "key", ["payload"], buckets=64)
    store.upsert(spark.range(2000).selectExpr("id AS key", "'p' AS payload", "id AS at"))
    before, layout = files(store), store.layout()
    assert len(layout.current) == 64
    batch = spark.createDataFrame([(k, "q", 0) for k in range(20)], SCHEMA)  # 1 % of the keys
    touched = set(store._held(batch, layout))
    assert 10 < len(touched) <= 20
    store.upsert(batch)
    after = store.layout()
    assert {b for b in after.current if after.current[b] != layout.current[b]} == touched
    assert {b for b in after.history if after.history[b] != layout.history[b]} == touched
    added = files(store) - before
    assert before <= files(store)  # nothing that readers may hold is touched
    assert {p.split("bucket_=")[1].split("/")[0] for p in added} == touched
    assert {tuple(r) for r in store.read(0, batch.select("key")).select("key", "payload", "latest").collect()} == {(k, "q", 2) for k in range(20)}
    paths = store.read(0, batch.select("key").limit(1)).inputFiles()
    assert all(any(f"bucket_={b}/" in p for b in touched) for p in paths) and len(paths) <= 2


def test_two_upserts_at_once(spark, monkeypatch):
    store = VersionStore(spark, fresh_path(spark, "versions"), "key", ["payload"], buckets=4)
    store.upsert(spark.createDataFrame([(1, "a", 0)], SCHEMA))
    plain, once = commits.put_if_absent, []

    def slow(session, path, text):
        if not once:
            once.append(path)
            store.upsert(spark.createDataFrame([(1, "b", 0)], SCHEMA))
        return plain(session, path, text)

    monkeypatch.setattr(version_store, "put_if_absent", slow)
    with pytest.raises(ValueError, match="not at state 1 any more"):
        store.upsert(spark.createDataFrame([(1, "c", 0)], SCHEMA))
    assert shown(store.read()) == [(1, 0, "b", 2), (1, 1, "a", -1), (1, 2, "b", -1)]
