"""Queries: run logs and versioned tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rankloom.functions.times import elapsed_seconds
from rankloom.operators import versions
from rankloom.operators.aggregates import distinct_names
from rankloom.operators.filters import changed_since, same_text, status_in
from rankloom.operators.ranking import latest_per_parent
from rankloom.operators.runlog import freshness_gate, new_data_available
from rankloom.plans import sql
from rankloom.plans.registry import query
from rankloom.plans.views import NOW, epoch_seconds, ntz, runs, table
from rankloom.session import fresh_path
from rankloom.sources.version_store import VersionStore

CUTOFF = "2000-07-01 00:00:00"
DAY = 86400


@query(
    "status_in",
    sql.with_(sql.RUNS)
    + """SELECT run_id, status, upper(status) = upper('active') AS active FROM runs
WHERE status IN ('ACTIVE', 'CREATE PENDING', 'CREATE IN_PROGRESS')""",
)
def status_in_query(spark, sf_dir):
    kept = status_in(runs(spark, sf_dir))
    return kept.select("run_id", "status", same_text(F.col("status"), F.lit("active")).alias("active"))


LATEST = """latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY created DESC, run_id) AS place FROM runs)
  WHERE place = 1)"""
NEWEST = """newest AS (
  SELECT o_custkey AS parent, max(l_shipdate) AS data_time FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  WHERE l_returnflag = 'R' GROUP BY 1)"""


@query(
    "latest_per_parent",
    sql.with_(
        sql.RUNS,
        """active AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY created DESC, run_id) AS place
                 FROM runs WHERE status = 'ACTIVE') WHERE place = 1)""",
    )
    + """SELECT c_custkey AS parent, coalesce(run_id, -1) AS run_id, run_id IS NOT NULL AS found
FROM customer LEFT JOIN active ON parent = c_custkey""",
)
def latest_per_parent_query(spark, sf_dir):
    parents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("parent"))
    newest = latest_per_parent(runs(spark, sf_dir), parents, "parent", "created", "run_id", F.col("status") == "ACTIVE")
    return newest.select("parent", F.coalesce("run_id", F.lit(-1)).alias("run_id"), "found")


def _last_runs(spark, sf_dir):
    parents = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("parent")).distinct()
    return latest_per_parent(runs(spark, sf_dir), parents, "parent", "created", "run_id")


def _newest_data(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    returned = lines.where(F.col("l_returnflag") == "R").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return returned.groupBy(F.col("o_custkey").alias("parent")).agg(F.max("l_shipdate").alias("data_time"))


@query(
    "new_data_available",
    sql.with_(sql.RUNS, LATEST, NEWEST)
    + "SELECT parent, run_id, coalesce(data_time > last_updated, FALSE) AS new_data FROM latest LEFT JOIN newest USING (parent)",
)
def new_data_available_query(spark, sf_dir):
    judged = new_data_available(_last_runs(spark, sf_dir), _newest_data(spark, sf_dir))
    return judged.select("parent", "run_id", "new_data")


@query(
    "freshness_gate",
    sql.with_(
        sql.RUNS,
        LATEST,
        NEWEST,
        f"""requests AS (
  SELECT c_custkey AS parent, 'job-' || c_nationkey AS name,
         CASE c_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 30 * {DAY} ELSE 365 * {DAY} END AS max_age
  FROM customer)""",
    )
    + f"""SELECT r.parent, coalesce(CASE
    WHEN 'job-' || (l.parent % 7) = r.name THEN TRUE
    WHEN l.status IS NULL OR l.status NOT IN ('ACTIVE', 'CREATE PENDING', 'CREATE IN_PROGRESS') THEN FALSE
    WHEN coalesce(max_age, 0) <> 0 AND l.status = 'ACTIVE' THEN NOT (
      TIMESTAMP '{NOW}' > l.last_updated + max_age * INTERVAL 1 SECOND AND coalesce(n.data_time > l.last_updated, TRUE))
    ELSE TRUE END, FALSE) AS is_current
FROM requests r LEFT JOIN latest l ON l.parent = r.parent LEFT JOIN newest n ON n.parent = r.parent""",
)
def freshness_gate_query(spark, sf_dir):
    nation = F.col("c_nationkey")
    max_age = F.when(nation % 4 == 1, 0).when(nation % 4 == 2, 30 * DAY).when(nation % 4 == 3, 365 * DAY)
    requests = (
        table(spark, sf_dir, "customer")
        .select(F.col("c_custkey").alias("parent"), F.concat(F.lit("job-"), nation.cast("string")).alias("name"), max_age.alias("max_age"))
        .join(_newest_data(spark, sf_dir), "parent", "left")
    )
    last = _last_runs(spark, sf_dir).withColumn("name", F.concat(F.lit("job-"), (F.col("parent") % 7).cast("string")))
    return freshness_gate(last, requests, ntz(NOW)).select("parent", "is_current")


@query(
    "changed_since",
    sql.with_(sql.RUNS)
    + f"""SELECT run_id FROM (
  SELECT run_id, status, priority IN ('1-URGENT', '2-HIGH') AS nested, priority = '1-URGENT' AS nested_active,
         CASE WHEN priority IN ('1-URGENT', '2-HIGH') THEN created ELSE last_updated END AS updated FROM runs)
WHERE status = 'ACTIVE' AND (NOT nested OR nested_active) AND updated > TIMESTAMP '{CUTOFF}'""",
)
def changed_since_query(spark, sf_dir):
    """Urgent and high runs carry a later update of their own, done or not."""
    update = F.struct(
        "created",
        F.col("created").alias("last_updated"),
        F.when(F.col("priority") == "1-URGENT", "ACTIVE").otherwise("UPDATING").alias("status"),
    )
    log = runs(spark, sf_dir).withColumn("latest_update", F.when(F.col("priority").isin("1-URGENT", "2-HIGH"), update))
    return changed_since(log, ntz(CUTOFF)).select("run_id")


# --- versioned tables ------------------------------------------------------

ORDERED = f"""ordered AS (
  SELECT o_custkey AS key, o_orderpriority AS payload, o_orderdate, o_orderkey,
         row_number() OVER (PARTITION BY o_custkey, o_orderdate < TIMESTAMP '{CUTOFF}' ORDER BY o_orderdate, o_orderkey) AS nth,
         row_number() OVER (PARTITION BY o_custkey, o_orderdate < TIMESTAMP '{CUTOFF}' ORDER BY o_orderdate DESC, o_orderkey DESC) AS back
  FROM orders)"""
HISTORY = f"""body AS (SELECT key, payload, nth AS version FROM ordered WHERE o_orderdate < TIMESTAMP '{CUTOFF}'),
heads AS (SELECT key, payload, nth AS latest FROM ordered WHERE o_orderdate < TIMESTAMP '{CUTOFF}' AND back = 1),
history AS (
  SELECT key, payload, version, CAST(NULL AS BIGINT) AS latest FROM body
  UNION ALL SELECT key, payload, 0, latest FROM heads)"""
UPSERTED = f"""later AS (
  SELECT b.key, b.payload, b.nth, coalesce(h.latest, 0) AS latest, h.key IS NOT NULL AS known,
         CASE WHEN b.nth = 1 THEN h.payload ELSE lag(b.payload) OVER (PARTITION BY b.key ORDER BY b.nth) END AS old
  FROM ordered b LEFT JOIN heads h ON h.key = b.key WHERE b.o_orderdate >= TIMESTAMP '{CUTOFF}'),
numbered AS (
  SELECT *, latest + count(*) OVER (PARTITION BY key ORDER BY nth) AS version FROM later
  WHERE (nth = 1 AND NOT known) OR payload IS DISTINCT FROM old),
newest AS (SELECT key, max_by(payload, version) AS payload, max(version) AS latest FROM numbered GROUP BY 1),
upserted AS (
  SELECT key, payload, version, CAST(NULL AS BIGINT) AS latest FROM body
  UNION ALL SELECT key, payload, version, NULL FROM numbered
  UNION ALL SELECT key, payload, 0, latest FROM newest
  UNION ALL SELECT key, payload, 0, latest FROM heads WHERE key NOT IN (SELECT key FROM newest))"""
SHOWN = "key, payload, CAST(version AS BIGINT) AS version, CAST(coalesce(latest, -1) AS BIGINT) AS latest"


def order_history(spark, sf_dir):
    """The orders of a customer before the cutoff as versions of one task."""
    early = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < ntz(CUTOFF))
    oldest_first = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    body = early.select(
        F.col("o_custkey").alias("key"),
        F.col("o_orderpriority").alias("payload"),
        F.row_number().over(oldest_first).cast("long").alias("version"),
    )
    heads = body.groupBy("key").agg(F.max_by("payload", "version").alias("payload"), F.max("version").alias("latest"))
    return body.withColumn("latest", F.lit(None).cast("long")).unionByName(
        heads.select("key", "payload", F.lit(0).cast("long").alias("version"), "latest")
    )


def later_orders(spark, sf_dir):
    late = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= ntz(CUTOFF))
    return late.select(
        F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("payload"), "o_orderdate", "o_orderkey"
    )


def _shown(df):
    return df.select("key", "payload", "version", F.coalesce("latest", F.lit(-1)).alias("latest"))


@query("versioned_upsert", sql.with_(ORDERED, HISTORY, UPSERTED) + f"SELECT {SHOWN} FROM upserted")
def versioned_upsert(spark, sf_dir):
    """Every later order is a change of its customer's task, unless it repeats the one before it."""
    history, batch = order_history(spark, sf_dir), later_orders(spark, sf_dir)
    return _shown(
        versions.versioned_upsert(history, batch, "key", ["payload"], arrival=["o_orderdate", "o_orderkey"])
    )


CHANGES = """ordered AS (
  SELECT o_custkey AS key, o_orderpriority AS payload, lag(o_orderpriority) OVER w AS old, row_number() OVER w AS nth
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
changes AS (
  SELECT key, payload, count(*) OVER (PARTITION BY key ORDER BY nth) AS version FROM ordered
  WHERE nth = 1 OR payload IS DISTINCT FROM old)"""


def _stored_orders(spark, sf_dir):
    """A stored table with the orders before the cutoff, then those after it."""
    store = VersionStore(spark, fresh_path(spark, "versions"), "key", ["payload"], buckets=16)
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("payload"), "o_orderdate", "o_orderkey"
    )
    early = F.col("o_orderdate") < ntz(CUTOFF)
    for batch in (orders.where(early), orders.where(~early)):
        store.upsert(batch, arrival=["o_orderdate", "o_orderkey"])
    return store


@query(
    "stored_versions",
    sql.with_(CHANGES)
    + """SELECT key, payload, version, CAST(-1 AS BIGINT) AS latest FROM changes
UNION ALL SELECT key, max_by(payload, version), 0, max(version) FROM changes GROUP BY key""",
)
def stored_versions(spark, sf_dir):
    return _shown(_stored_orders(spark, sf_dir).read())


@query(
    "stored_versions_of_keys",
    sql.with_(CHANGES)
    + """SELECT key, max_by(payload, version) AS payload, max(version) AS latest FROM changes
WHERE key IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY key""",
)
def stored_versions_of_keys(spark, sf_dir):
    some = table(spark, sf_dir, "customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("key"))
    return _stored_orders(spark, sf_dir).read(0, some).select("key", "payload", "latest")


@query(
    "read_version",
    sql.with_(ORDERED, HISTORY) + "SELECT key, payload, CAST(version AS BIGINT) AS version FROM history WHERE version IN (0, 3)",
)
def read_version(spark, sf_dir):
    history = order_history(spark, sf_dir)
    both = versions.read_version(history).unionByName(versions.read_version(history, 3))
    return both.select("key", "payload", "version")


@query(
    "delete_versions",
    sql.with_(ORDERED, HISTORY)
    + f"""SELECT {SHOWN} FROM history
WHERE key NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '{CUTOFF}' AND o_orderpriority = '1-URGENT')""",
)
def delete_versions(spark, sf_dir):
    """An urgent later order marks its customer for deletion in the batch."""
    late = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= ntz(CUTOFF))
    marked = late.where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("key")).distinct()
    batch = marked.withColumn("payload", F.lit(versions.DELETE))
    return _shown(versions.versioned_upsert(order_history(spark, sf_dir), batch, "key", ["payload"], marker="payload"))


@query(
    "next_version",
    sql.with_(ORDERED, HISTORY) + "SELECT key, CAST(max(version) + 1 AS BIGINT) AS next_version FROM history GROUP BY key",
)
def next_version(spark, sf_dir):
    return versions.next_version(order_history(spark, sf_dir), "key")


@query("distinct_names", sql.with_(ORDERED, HISTORY) + "SELECT DISTINCT key FROM history")
def distinct_names_query(spark, sf_dir):
    return distinct_names(order_history(spark, sf_dir), "key")


@query(
    "run_ages",
    sql.with_(sql.RUNS)
    + f"""SELECT run_id, CAST(floor(epoch(created)) AS BIGINT) AS created_seconds,
       date_diff('second', created, last_updated) AS duration, date_diff('second', last_updated, TIMESTAMP '{NOW}') AS age
FROM runs""",
)
def run_ages(spark, sf_dir):
    return runs(spark, sf_dir).select(
        "run_id",
        epoch_seconds("created").alias("created_seconds"),
        elapsed_seconds(F.col("created"), F.col("last_updated")).alias("duration"),
        elapsed_seconds(F.col("last_updated"), ntz(NOW)).alias("age"),
    )
