"""Queries: streams over the given table files, run until no row is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.plans import sql
from rankloom.plans.registry import query
from rankloom.plans.tables import counter_points
from rankloom.plans.views import table
from rankloom.session import fresh_path, materialise
from rankloom.streaming import feeds
from rankloom.streaming.status import status_changes, status_changes_batch, stored_changes

STATUS_CUTOFF = "2000-07-01 00:00:00"


def _events_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return feeds.read_feed(spark, sf_dir, schema, "events.parquet")


def _interactions(stream):
    return stream.select(
        F.col("user_id").alias("USER_ID"),
        F.get_json_object("props", "$.k").cast("long").alias("ITEM_ID"),
        F.col("ts").alias("TS"),
        F.col("event_type").alias("EVENT_TYPE"),
        F.col("value").alias("EVENT_VALUE"),
    )


@query(
    "event_ingest",
    'SELECT event_id, user_id AS "USER_ID", CAST(json_extract(props, \'$.k\') AS BIGINT) AS "ITEM_ID", event_type AS "EVENT_TYPE" FROM events',
)
def event_ingest(spark, sf_dir):
    """Every event is delivered twice and must arrive once."""
    sink, checkpoint = fresh_path(spark, "ingested"), fresh_path(spark, "checkpoint")
    twice = _events_stream(spark, sf_dir).union(_events_stream(spark, sf_dir))
    feeds.ingest_events(twice, sink, checkpoint).awaitTermination()
    return feeds.stored_events(spark, sink).select(
        "event_id",
        F.col("user_id").alias("USER_ID"),
        F.get_json_object("props", "$.k").cast("long").alias("ITEM_ID"),
        F.col("event_type").alias("EVENT_TYPE"),
    )


@query(
    "windowed_counters",
    sql.with_(sql.IX_EVENTS)
    + """SELECT strftime(date_trunc('day', TS), '%Y-%m-%d') AS day, 'events' AS service, EVENT_TYPE AS name, count(*) AS total
FROM ix_events GROUP BY 1, 2, 3""",
)
def windowed_counters(spark, sf_dir):
    """All days, those still open included."""
    sink, checkpoint = fresh_path(spark, "counters"), fresh_path(spark, "checkpoint")
    points = counter_points(_interactions(_events_stream(spark, sf_dir)))
    feeds.write_counters(points, sink, checkpoint).awaitTermination()
    stored = feeds.stored_counters(spark, sink)
    return stored.select(F.date_format("period_start", "yyyy-MM-dd").alias("day"), "service", "name", "total")


@query("refresh_popularity", sql.with_(sql.IX_EVENTS) + "SELECT ITEM_ID, count(*) AS score FROM ix_events GROUP BY ITEM_ID")
def refresh_popularity(spark, sf_dir):
    store, checkpoint = fresh_path(spark, "popularity"), fresh_path(spark, "checkpoint")
    feeds.refresh_popularity(_interactions(_events_stream(spark, sf_dir)), store, checkpoint).awaitTermination()
    return feeds.stored_popularity(spark, store)


STATUS_ROWS = (
    sql.with_(sql.RUNS)
    + f"""SELECT CAST(run_id AS VARCHAR) AS key, 'CREATING' AS status, CAST(floor(epoch(created)) AS BIGINT) AS at, -1 AS duration FROM runs
UNION ALL
SELECT CAST(run_id AS VARCHAR), 'UPDATING', CAST(floor(epoch(created + INTERVAL 1 HOUR)) AS BIGINT), -1
FROM runs WHERE priority = '2-HIGH'
UNION ALL
SELECT CAST(run_id AS VARCHAR), 'ACTIVE', CAST(floor(epoch(last_updated)) AS BIGINT),
       CASE WHEN last_updated = created THEN -1 ELSE date_diff('second', created, last_updated) END
FROM runs WHERE status = 'ACTIVE' AND last_updated > TIMESTAMP '{STATUS_CUTOFF}'"""
)


def _two_sightings(orders, shipped):
    """Each run is seen when it starts and once more in its last state; high ones are updated in between."""
    last = F.greatest("o_orderdate", F.coalesce("shipped", "o_orderdate")).cast("timestamp")
    created = F.col("o_orderdate").cast("timestamp")
    final = F.when(F.col("o_orderstatus") == "F", "ACTIVE").when(F.col("o_orderstatus") == "O", "CREATE IN_PROGRESS").otherwise("CREATE FAILED")

    def seen(status, at):
        return F.struct(status.alias("status"), created.alias("created"), at.alias("last_updated"))

    update = seen(F.lit("UPDATE IN_PROGRESS"), created + F.expr("INTERVAL 1 HOUR"))
    sightings = F.array_compact(
        F.array(
            seen(F.lit("CREATE PENDING"), created),
            F.when(F.col("o_orderpriority") == "2-HIGH", update),
            seen(final, last),
        )
    )
    joined = orders.join(shipped, orders.o_orderkey == shipped.l_orderkey, "left")
    return joined.select(F.col("o_orderkey").cast("string").alias("key"), F.explode(sightings).alias("seen")).select("key", "seen.*")


def _plain(changes):
    return changes.select("key", "status", F.unix_timestamp("at").alias("at"), F.coalesce("duration", F.lit(-1)).alias("duration"))


def _shipped(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))


@query("status_changes", STATUS_ROWS)
def status_changes_query(spark, sf_dir):
    sink, checkpoint = fresh_path(spark, "status"), fresh_path(spark, "checkpoint")
    schema = table(spark, sf_dir, "orders").schema
    orders = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    shipped = materialise(_shipped(spark, sf_dir), "shipped")
    status_changes(_two_sightings(orders, shipped), sink, checkpoint, STATUS_CUTOFF).awaitTermination()
    return _plain(stored_changes(spark, sink))


@query("status_changes_batch", STATUS_ROWS)
def status_changes_batch_query(spark, sf_dir):
    sightings = _two_sightings(table(spark, sf_dir, "orders"), _shipped(spark, sf_dir))
    return _plain(status_changes_batch(sightings, STATUS_CUTOFF))


@query(
    "arriving_files",
    """SELECT outcome, count(*) AS files FROM (
  SELECT DISTINCT c_nationkey, unnest(['processed', CASE WHEN c_nationkey % 5 = 0 THEN 'failed' ELSE 'succeeded' END]) AS outcome
  FROM customer) GROUP BY 1""",
)
def arriving_files(spark, sf_dir):
    """One file per nation with its customers. In every fifth some line is not valid JSON, the first one is."""
    root, checkpoint, counts = (fresh_path(spark, n) for n in ("arriving", "checkpoint", "outcomes"))
    customers = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_mktsegment")
    last = customers.groupBy("c_nationkey").agg(F.max("c_custkey").alias("last"))
    broken = (F.col("c_nationkey") % 5 == 0) & (F.col("c_custkey") == F.col("last"))
    line = F.when(broken, F.col("c_mktsegment")).otherwise(F.to_json(F.struct("c_custkey", "c_mktsegment")))
    lines = customers.join(last, "c_nationkey").select(line.alias("value"), F.col("c_nationkey").alias("nation"), "c_custkey")
    per_nation = lines.repartition("nation").sortWithinPartitions("nation", "c_custkey").drop("c_custkey")
    per_nation.write.partitionBy("nation").option("compression", "none").text(root)
    valid = F.json_object_keys("value").isNotNull()
    feeds.arriving_files(
        spark, f"{root}/nation=*", "*.txt", checkpoint, valid, lambda batch, number: None, counts, by_line=True
    ).awaitTermination()
    return feeds.stored_outcomes(spark, counts).select("outcome", F.col("count").alias("files"))
