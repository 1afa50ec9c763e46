"""The store of merged runs, and files that are committed once."""

from __future__ import annotations

import random
import threading

import pytest

from rankloom.session import fresh_path
from rankloom.sources import commits, run_store
from rankloom.sources.run_store import RunStore, merge_suffix


@pytest.mark.parametrize("fanout", [2, 3, 8])
def test_runs_stay_few(fanout):
    levels, written = [], 0
    for batch in range(1, 1001):
        levels.append(0)
        merge = merge_suffix(levels, fanout)
        if merge is not None:
            start, level = merge
            levels[start:] = [level]
            written += 1
        bound = (fanout - 1) * (1 + next(k for k in range(20) if fanout**k > batch))
        assert len(levels) <= bound and levels == sorted(levels, reverse=True)
        assert max(levels.count(level) for level in levels) < fanout
    assert written <= 1000 // (fanout - 1)


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "k long, n long, first long")


def test_sums_and_minima_over_many_batches(spark):
    rng = random.Random(7)
    root = fresh_path(spark, "store")
    store = RunStore(spark, root, ["k"], {"n": "sum", "first": "min"}, fanout=3, keep=2)
    assert store.read() is None
    want = {}
    for number in range(14):
        batch = [(rng.randrange(6), rng.randrange(100), rng.randrange(100)) for _ in range(8)]
        assert store.add(rows(spark, batch), number, "a")
        assert not store.add(rows(spark, batch), number, "a")  # run again
        for k, n, first in batch:
            total, least = want.get(k, (0, 1000))
            want[k] = (total + n, min(least, first))
    assert {r.k: (r.n, r["first"]) for r in store.read().collect()} == want
    assert len(store.manifest().runs) <= 6
    # Old manifests and merged runs are gone but for those of the last batches.
    assert len(commits.names(spark, f"{root}/manifests")) <= 3
    assert len(commits.names(spark, f"{root}/runs")) <= 6 + 2 * 3
    assert store.add(rows(spark, [(1, 5, 0)]), 0, "another writer")
    assert {r.k: r.n for r in store.read().collect()}[1] == want[1][0] + 5


def test_plain_rows_by_partition(spark):
    store = RunStore(spark, fresh_path(spark, "store"), [], partition=("day",), fanout=2)
    for number in range(5):
        store.add(spark.createDataFrame([(number, f"d{number % 2}"), (number, "d9")], "x long, day string"), number)
    store.add(spark.createDataFrame([], "x long, day string"), 5)
    assert sorted(tuple(r) for r in store.read().collect()) == sorted([(n, f"d{n % 2}") for n in range(5)] + [(n, "d9") for n in range(5)])
    day = store.read().where("day = 'd1'")
    assert "PartitionFilters: [isnotnull(day" in day._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.x for r in day.collect()) == [1, 3]


def test_two_writers_at_once(spark, monkeypatch):
    """Another writer commits between the look at the manifest and the commit."""
    store = RunStore(spark, fresh_path(spark, "store"), ["k"], {"n": "sum", "first": "min"}, fanout=2)
    store.add(rows(spark, [(1, 1, 1)]), 0, "a")
    once = []

    def slow(session, path, text):
        if not once:
            once.append(path)
            assert store.add(rows(spark, [(1, 10, 0)]), 0, "b")
        return commits.put_if_absent(session, path, text)

    monkeypatch.setattr(run_store, "put_if_absent", slow)
    assert store.add(rows(spark, [(1, 100, 5)]), 1, "a")
    assert [tuple(r) for r in store.read().collect()] == [(1, 111, 0)]
    assert store.manifest().done == {"a": 1, "b": 0}


@pytest.mark.parametrize("take", ["_link", "_rename"])
def test_one_of_many_writers_commits(spark, monkeypatch, take):
    """All writers have their drafts before the first one takes the name."""
    path = fresh_path(spark, "commit")
    barrier, won = threading.Barrier(6, timeout=60), []
    plain = getattr(commits, take)

    def together(session, draft, target):
        barrier.wait()
        if take == "_rename":  # renaming is not atomic on a local disk
            with lock:
                return plain(session, draft, target)
        return plain(session, draft, target)

    lock = threading.Lock()
    monkeypatch.setattr(commits, "_link", together)

    def write(k):
        if commits.put_if_absent(spark, f"{path}/one", f"text of {k} ä"):
            won.append(k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    monkeypatch.undo()
    assert len(won) == 1
    assert commits.read_text(spark, f"{path}/one") == f"text of {won[0]} ä"
    assert commits.names(spark, path) == ["one"]
    assert not commits.put_if_absent(spark, f"{path}/one", "again") and commits.names(spark, f"{path}/none") == []
