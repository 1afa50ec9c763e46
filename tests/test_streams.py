from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rankloom.session import fresh_path
from rankloom.streaming import feeds
from rankloom.streaming.status import status_changes, status_changes_batch, stored_changes

EVENTS = "event_id long, ts timestamp, user_id long, ITEM_ID long"
START = datetime(2024, 1, 1)


def add(spark, path, rows, schema=EVENTS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def feed(spark, path, schema=EVENTS, ts="ts"):
    return feeds.read_feed(spark, path, schema, ts=ts)


def make(ids, rng):
    return [(i, START + timedelta(minutes=7 * i), i % 5, rng.randrange(9)) for i in ids]


def test_ingest_in_any_order_and_after_restart(spark):
    rng = random.Random(1)
    source, sink, checkpoint = (fresh_path(spark, n) for n in ("source", "sink", "checkpoint"))
    first = make(range(50), rng)
    rng.shuffle(first)
    add(spark, source, first + first[:10])
    feeds.ingest_events(feed(spark, source), sink, checkpoint).awaitTermination()
    add(spark, source, make(range(40, 80), rng))

    add(spark, source, [(900, START - timedelta(days=400), 1, 1), (901, START - timedelta(days=400), 1, 1)])
    feeds.ingest_events(feed(spark, source), sink, checkpoint).awaitTermination()
    assert sorted(r.event_id for r in feeds.stored_events(spark, sink).collect()) == [*range(80), 900, 901]


def test_counters_hold_open_periods_and_late_events(spark):
    source, sink, checkpoint = (fresh_path(spark, n) for n in ("source", "sink", "checkpoint"))
    rows = make(range(600), random.Random(2))
    random.Random(3).shuffle(rows)
    want = {}
    for part in (rows[:300], rows[300:], [(1000, START - timedelta(days=90), 1, 1)]):
        add(spark, source, part)
        points = feed(spark, source).select(
            F.col("ts").alias("TS"), F.lit("s").alias("service"), F.lit("n").alias("name"), F.lit(1).alias("value")
        )
        feeds.write_counters(points, sink, checkpoint, "1 day").awaitTermination()
        for row in part:
            day = row[1].replace(hour=0, minute=0)
            want[day] = want.get(day, 0) + 1
    assert {r.period_start: r.total for r in feeds.stored_counters(spark, sink).collect()} == want


def test_live_popularity_follows_new_files(spark):
    source, store, checkpoint = (fresh_path(spark, n) for n in ("source", "store", "checkpoint"))
    rows = []
    for seed in (4, 5, 6):
        more = make(range(seed * 100, seed * 100 + 60), random.Random(seed))
        rows += more
        add(spark, source, more)
        feeds.refresh_popularity(feed(spark, source), store, checkpoint).awaitTermination()
    want = {}
    for row in rows:
        want[row[3]] = want.get(row[3], 0) + 1
    assert {r.ITEM_ID: r.score for r in feeds.stored_popularity(spark, store).collect()} == want
    base = spark.createDataFrame([(3, 1000), (77, 5)], "ITEM_ID long, score long")
    on_top = {r.ITEM_ID: r.score for r in feeds.stored_popularity(spark, store, base).collect()}
    assert on_top[77] == 5 and on_top[3] == want.get(3, 0) + 1000


SIGHTING = "key string, status string, created timestamp, last_updated timestamp"


def sightings():
    at = START
    return [
        [("a", "CREATE PENDING", at, at), ("b", "CREATE PENDING", at, at), ("old", "ACTIVE", at, at - timedelta(days=1))],
        [("a", "CREATE IN_PROGRESS", at, at + timedelta(hours=1)), ("b", "ACTIVE", at, at + timedelta(hours=2))],
        [("a", "ACTIVE", at, at + timedelta(hours=3)), ("b", "ACTIVE", at, at + timedelta(hours=9)), ("c", "ACTIVE", at + timedelta(hours=5), at + timedelta(hours=5))],
        [("a", "UPDATE PENDING", at, at + timedelta(hours=4)), ("a", "UPDATE IN_PROGRESS", at, at + timedelta(hours=6)), ("a", "ACTIVE", at, at + timedelta(hours=8)), ("n", "ACTIVE", None, at + timedelta(hours=8))],
    ]


def test_status_changes_over_restarts(spark):
    cutoff = str(START)
    whole = spark.createDataFrame([r for rows in sightings() for r in rows], SIGHTING)
    want = sorted((tuple(r) for r in status_changes_batch(whole, cutoff).collect()), key=str)
    assert ("b", "ACTIVE", START + timedelta(hours=2), 7200) in want
    assert ("c", "ACTIVE", START + timedelta(hours=5), None) in want
    assert ("a", "UPDATING", START + timedelta(hours=4), None) in want
    assert not any(r[0] == "old" and r[1] == "ACTIVE" for r in want)
    assert not any(r[0] == "n" for r in want)
    source, sink, checkpoint = (fresh_path(spark, n) for n in ("source", "sink", "checkpoint"))
    for rows in sightings():
        add(spark, source, rows, SIGHTING)
        stream = spark.readStream.schema(SIGHTING).parquet(source)
        status_changes(stream, sink, checkpoint, cutoff).awaitTermination()
    stored = stored_changes(spark, sink)
    assert sorted((tuple(r) for r in stored.collect()), key=str) == want


def test_status_changes_do_not_depend_on_the_order_of_arrival(spark):
    cutoff = str(START)
    whole = spark.createDataFrame([r for rows in sightings() for r in rows], SIGHTING)
    want = sorted((tuple(r) for r in status_changes_batch(whole, cutoff).collect()), key=str)
    source, sink, checkpoint = (fresh_path(spark, n) for n in ("source", "sink", "checkpoint"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before, read = spark.conf.get(provider), []
    for rows in reversed(sightings()):  # later times first, a restart in between
        add(spark, source, rows, SIGHTING)
        stream = spark.readStream.schema(SIGHTING).parquet(source)
        query = status_changes(stream, sink, checkpoint, cutoff)
        query.awaitTermination()
        read.append(sum(p.numInputRows for p in query.recentProgress))
        state = query.lastProgress.stateOperators[0]
    assert sorted((tuple(r) for r in stored_changes(spark, sink).collect()), key=str) == want
    assert read == [len(rows) for rows in reversed(sightings())]  # a batch reads its own rows only
    assert state.numRowsTotal == 4 and any("rocksdb" in k.lower() for k in state.customMetrics)
    assert spark.conf.get(provider) == before
    assert "Python" not in query._jsq.explainInternal(False)


def test_files_are_judged_by_all_their_lines(spark, tmp_path):
    checkpoint, counts = fresh_path(spark, "checkpoint"), fresh_path(spark, "counts")
    (tmp_path / "good.json").write_text('{"x": 1}\n{"x": 2}\n')
    (tmp_path / "late.json").write_text('{"x": 1}\n' * 50 + "{broken\n")
    lines = []
    valid = F.json_object_keys("value").isNotNull()
    feeds.arriving_files(
        spark, str(tmp_path), "*.json", checkpoint, valid, lambda b, n: lines.extend(b.collect()), counts, by_line=True
    ).awaitTermination()
    assert {r.path.rsplit("/", 1)[-1]: r.ok for r in lines} == {"good.json": True, "late.json": False}
    assert len(lines) == 53
    stored = {r.outcome: r["count"] for r in feeds.stored_outcomes(spark, counts).collect()}
    assert stored == {"processed": 2, "succeeded": 1, "failed": 1}


def test_arriving_files_are_counted_once(spark, tmp_path):
    checkpoint, counts = fresh_path(spark, "checkpoint"), fresh_path(spark, "counts")
    valid = F.json_object_keys("value").isNotNull()
    arrived = []

    def note(batch, number):
        arrived.extend(r.path.rsplit("/", 1)[-1] for r in batch.where("ok").collect())

    for name, text in (("a.json", '{"x": 1}'), ("b.json", "{broken"), ("c.txt", "{}")):
        (tmp_path / name).write_text(text)
    feeds.arriving_files(spark, str(tmp_path), "*.json", checkpoint, valid, note, counts).awaitTermination()
    (tmp_path / "d.json").write_text('{\n "x": 2\n}')
    feeds.arriving_files(spark, str(tmp_path), "*.json", checkpoint, valid, note, counts).awaitTermination()
    assert sorted(arrived) == ["a.json", "d.json"]
    assert {r.outcome: r["count"] for r in feeds.stored_outcomes(spark, counts).collect()} == {"processed": 3, "succeeded": 2, "failed": 1}
