"""Streams of interactions: ingest, counters, live popularity, arriving files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankloom.operators.aggregates import metric_counters
from rankloom.session import materialise
from rankloom.sources.run_store import RunStore


def read_feed(spark: SparkSession, path: str, schema, glob: str = "*.parquet", ts: str = "ts") -> DataFrame:
    """A folder of event files as a stream, with a UTC event time."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path)
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def stored_rows(store: RunStore) -> DataFrame:
    """What the store holds; an error if no batch has come yet."""
    rows = store.read()
    if rows is None:
        raise ValueError(f"nothing has been stored at {store.root} yet")
    return rows


def _events(spark: SparkSession, sink: str) -> RunStore:
    return RunStore(spark, sink, [], partition=("day",))


def ingest_events(
    stream: DataFrame, sink: str, checkpoint: str, id: str = "event_id", ts: str = "ts"
) -> StreamingQuery:
    """Append new events to the dataset at ``sink``; run until none is left.

    Each micro-batch is freed of repeats and of the events stored before on the
    days it touches, however late it comes; nothing is dropped for its age. A
    batch that is run again changes nothing.
    """

    def append(batch: DataFrame, number: int) -> None:
        store = _events(batch.sparkSession, sink)
        fresh = batch.dropDuplicates([id]).withColumn("day", F.to_date(ts))
        stored = store.read()
        if stored is not None:
            days = materialise(fresh.select("day").distinct(), "days")
            known = stored.join(days, "day", "left_semi").select(id)
            fresh = fresh.join(known, id, "left_anti")
        store.add(fresh, number, checkpoint)

    return each_batch(stream, checkpoint, append)


def stored_events(spark: SparkSession, sink: str) -> DataFrame:
    """The events at ``sink`` with their day."""
    return stored_rows(_events(spark, sink))


def _counters(spark: SparkSession, sink: str) -> RunStore:
    return RunStore(spark, sink, ["period_start", "service", "name"], {"total": "sum"})


def write_counters(stream: DataFrame, sink: str, checkpoint: str, period: str = "1 day") -> StreamingQuery:
    """``metric_counters`` of a stream of TS, service, name, value.

    Each batch adds what it counted; ``stored_counters`` sums it up. Open
    periods are there from their first event on, and late events count.
    """

    def append(batch: DataFrame, number: int) -> None:
        _counters(batch.sparkSession, sink).add(metric_counters(batch, period), number, checkpoint)

    return each_batch(stream, checkpoint, append)


def stored_counters(spark: SparkSession, sink: str) -> DataFrame:
    """period_start, service, name, total over all batches."""
    return stored_rows(_counters(spark, sink))


def each_batch(
    stream: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None], mode: str = "append"
) -> StreamingQuery:
    return (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .foreachBatch(work)
        .start()
    )


def _popularity(spark: SparkSession, store: str) -> RunStore:
    return RunStore(spark, store, ["ITEM_ID"], {"score": "sum"})


def refresh_popularity(stream: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Keep item counts up to date between full rebuilds.

    Each batch adds the counts of the items it touched; a batch that is run
    again changes nothing.
    """

    def append(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("ITEM_ID").agg(F.count(F.lit(1)).alias("score"))
        _popularity(batch.sparkSession, store).add(counts, number, checkpoint)

    return each_batch(stream, checkpoint, append)


def stored_popularity(spark: SparkSession, store: str, base: DataFrame | None = None) -> DataFrame:
    """The live item counts of all batches, on top of the counts of the last
    full rebuild if ``base`` (ITEM_ID, score) is given."""
    live = stored_rows(_popularity(spark, store))
    if base is None:
        return live
    return live.unionByName(base).groupBy("ITEM_ID").agg(F.sum("score").alias("score"))


def compact_popularity(spark: SparkSession, store: str, target: str) -> None:
    """Sum the batches up into a base for a fresh store."""
    stored_popularity(spark, store).write.mode("errorifexists").parquet(target)


def _outcomes(spark: SparkSession, counts: str) -> RunStore:
    return RunStore(spark, counts, ["outcome"], {"count": "sum"})


def stored_outcomes(spark: SparkSession, counts: str) -> DataFrame:
    """outcome, count of the files that have arrived."""
    return stored_rows(_outcomes(spark, counts))


def arriving_files(
    spark: SparkSession,
    root: str,
    glob: str,
    checkpoint: str,
    valid: Column,
    on_batch: Callable[[DataFrame, int], None],
    counts: str,
    by_line: bool = False,
) -> StreamingQuery:
    """React to new files: rows ``path``, ``value`` and ``ok``.

    ``valid`` judges ``value``: the whole text, which suits parameter files, or
    with ``by_line`` each line, which suits data files of any size. A file is ok
    if all its lines are. Each batch goes to ``on_batch`` and adds a row per
    outcome (processed, succeeded, failed) to the store at ``counts``.
    """
    files = spark.readStream.option("pathGlobFilter", glob).option("wholetext", not by_line).format("text").load(root)
    judged = files.select(F.col("_metadata.file_path").alias("path"), "value", F.coalesce(valid, F.lit(False)).alias("ok"))

    def react(batch: DataFrame, number: int) -> None:
        kept = materialise(batch, "arrived")
        per_file = materialise(kept.groupBy("path").agg(F.bool_and("ok").alias("ok")), "arrived-files")
        on_batch(kept.drop("ok").join(per_file, "path"), number)
        outcomes = per_file.select(F.explode(F.array(F.lit("processed"), F.when(F.col("ok"), "succeeded").otherwise("failed"))).alias("outcome"))
        _outcomes(batch.sparkSession, counts).add(outcomes.groupBy("outcome").count(), number, checkpoint)

    return each_batch(judged, checkpoint, react)
