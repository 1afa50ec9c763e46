"""Status changes of long-running work, as a stream and as a batch.

Per key: one CREATING row, one UPDATING row when an update of it is first seen,
and one ACTIVE row when it has become ACTIVE after the cutoff. Sightings without
a created or last-updated time give no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rankloom.sources.run_store import RunStore
from rankloom.streaming.feeds import each_batch, stored_rows

# The status words of the three rows.
CREATING, UPDATING, ACTIVE = "CREATING", "UPDATING", "ACTIVE"
# Fixed value: how the status of work under update begins.
UPDATE = "UPDATE"

OUTPUT = "key string, status string, at timestamp, duration long"

STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def earliest(df: DataFrame, cutoff: str) -> DataFrame:
    """Per key the earliest creation, update, and time (with its creation) of having become ready."""
    timed = df.where("created IS NOT NULL AND last_updated IS NOT NULL")
    ready = (F.col("status") == ACTIVE) & (F.col("last_updated") > F.lit(cutoff).cast("timestamp"))
    updating = F.col("status").startswith(UPDATE)
    return timed.groupBy("key").agg(
        F.min("created").alias("first"),
        F.min(F.when(updating, F.col("last_updated"))).alias("update"),
        F.min(F.when(ready, F.struct("last_updated", "created"))).alias("done"),
    )


def change_rows(per_key: DataFrame) -> DataFrame:
    """The change rows of ``earliest``."""
    seconds = F.timestamp_diff("SECOND", F.col("done.created"), F.col("done.last_updated"))

    def row(status: str, at, duration):
        return F.struct(F.lit(status).alias("status"), at.alias("at"), duration.cast("long").alias("duration"))

    rows = F.array_compact(
        F.array(
            row(CREATING, F.col("first"), F.lit(None)),
            F.when(F.col("update").isNotNull(), row(UPDATING, F.col("update"), F.lit(None))),
            F.when(F.col("done").isNotNull(), row(ACTIVE, F.col("done.last_updated"), F.when(seconds != 0, seconds))),
        )
    )
    return per_key.select("key", F.explode(rows).alias("change")).select("key", "change.*")


def status_changes_batch(df: DataFrame, cutoff: str) -> DataFrame:
    """Change rows of key, status, created, last_updated: key, status, at,
    duration (whole seconds, null if 0). Of several sightings the earliest counts."""
    return change_rows(earliest(df, cutoff))


def _store(spark: SparkSession, sink: str) -> RunStore:
    return RunStore(spark, sink, ["key"], {"first": "min", "update": "min", "done": "min"})


def status_changes(stream: DataFrame, sink: str, checkpoint: str, cutoff: str) -> StreamingQuery:
    """Keep the changes of a stream of sightings at ``sink``; read them with ``stored_changes``.

    The earliest times of a key are streaming state, with no watermark: a key
    never expires, and an earlier sighting that comes late moves its change.
    State lies in RocksDB, off the heap, and its changes in the checkpoint. A
    batch reads its own rows and the state of its keys, and stores the keys it
    touched.
    """

    def append(batch: DataFrame, number: int) -> None:
        _store(batch.sparkSession, sink).add(batch, number, checkpoint)

    conf = stream.sparkSession.conf
    before = {name: conf.get(name, None) for name in STATE_SETTINGS}
    for name, value in STATE_SETTINGS.items():
        conf.set(name, value)
    try:  # the stream keeps the settings it starts with
        return each_batch(earliest(stream, cutoff), checkpoint, append, "update")
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


def stored_changes(spark: SparkSession, sink: str) -> DataFrame:
    """The change rows of all batches: key, status, at, duration."""
    return change_rows(stored_rows(_store(spark, sink)))
