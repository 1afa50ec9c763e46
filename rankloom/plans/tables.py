"""Queries: joins, set operations, aggregates and rule reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions.documents import unexpected_keys
from rankloom.functions.names import LABEL_LIMIT, run_label
from rankloom.functions.numeric import round6
from rankloom.operators import aggregates, relations
from rankloom.operators.filters import update_supported
from rankloom.plans import sql
from rankloom.plans.registry import query
from rankloom.plans.views import edges, epoch_seconds, ix_events, ix_orders, items, table, users

KINDS = ["region", "nation", "customer"]


def _regions(spark, sf_dir):
    return table(spark, sf_dir, "region").select(F.concat(F.lit("region/"), F.col("r_regionkey").cast("string")).alias("key"))


@query("ownership_closure", sql.with_(sql.EDGES, sql.OWNERS) + "SELECT owner, child, CAST(level AS BIGINT) AS level FROM owners")
def ownership_closure(spark, sf_dir):
    return relations.ownership(edges(spark, sf_dir), _regions(spark, sf_dir), kinds=KINDS)


@query("ownership_any_depth", sql.with_(sql.EDGES, sql.OWNERS) + "SELECT owner, child FROM owners")
def ownership_any_depth(spark, sf_dir):
    return relations.ownership_any_depth(edges(spark, sf_dir))


@query(
    "owned_by",
    sql.with_(sql.EDGES, sql.OWNERS)
    + """SELECT 'order/' || l_orderkey AS child, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem
WHERE 'order/' || l_orderkey IN (SELECT child FROM owners WHERE owner = 'region/2') GROUP BY 1""",
)
def owned_by(spark, sf_dir):
    owners = relations.ownership(edges(spark, sf_dir), _regions(spark, sf_dir), kinds=KINDS)
    totals = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("quantity"))
    candidates = totals.select(F.concat(F.lit("order/"), F.col("l_orderkey").cast("string")).alias("child"), "quantity")
    return relations.owned_by(candidates, owners, "region/2")


@query(
    "available_keys",
    sql.with_(sql.EDGES, sql.OWNERS)
    + """SELECT 'customer/' || p_partkey AS key FROM part
WHERE 'customer/' || p_partkey NOT IN (SELECT child FROM owners UNION SELECT owner FROM owners)""",
)
def available_keys(spark, sf_dir):
    owners = relations.ownership(edges(spark, sf_dir), _regions(spark, sf_dir), kinds=KINDS)
    candidates = table(spark, sf_dir, "part").select(
        F.concat(F.lit("customer/"), F.col("p_partkey").cast("string")).alias("key")
    )
    return relations.available_keys(candidates, owners)


@query("union_keys", "SELECT o_custkey AS key FROM orders UNION SELECT user_id FROM events")
def union_keys(spark, sf_dir):
    return relations.union_keys(table(spark, sf_dir, "orders").select("o_custkey"), table(spark, sf_dir, "events").select("user_id"))


@query("except_keys", "SELECT c_custkey AS key FROM customer EXCEPT SELECT user_id FROM events")
def except_keys(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return relations.except_keys(customers, table(spark, sf_dir, "events").select("user_id"))


@query(
    "reconcile",
    """WITH expected AS (
  SELECT o_orderkey AS id, o_orderstatus AS status, o_custkey AS owner,
         '{"status":"' || o_orderstatus || '","urgent":' || CASE WHEN o_orderpriority = '1-URGENT' THEN 'true' ELSE 'false' END || '}' AS doc
  FROM orders),
actual AS (
  SELECT l_orderkey AS id,
         lower(CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) ELSE 'P' END) AS status,
         CASE WHEN min(l_linestatus) = max(l_linestatus) THEN min(l_linestatus) ELSE 'P' END AS doc_status,
         max(l_linenumber) = 7 AS urgent
  FROM lineitem GROUP BY l_orderkey),
judged AS (
  SELECT coalesce(e.id, a.id) AS id,
         CASE WHEN a.id IS NULL THEN 'missing' WHEN e.id IS NULL THEN 'unexpected' ELSE 'both' END AS side,
         lower(e.status) IS DISTINCT FROM lower(a.status) AS bad_status,
         (a.id IS NULL) OR (e.id IS NULL) OR json_extract_string(e.doc, '$.status') IS DISTINCT FROM a.doc_status
           OR CAST(json_extract(e.doc, '$.urgent') AS BOOLEAN) IS DISTINCT FROM a.urgent AS bad_doc
  FROM expected e FULL OUTER JOIN actual a ON a.id = e.id)
SELECT id, side, concat_ws(',', CASE WHEN bad_status THEN 'status' END, CASE WHEN bad_doc THEN 'doc' END) AS mismatches
FROM judged WHERE side <> 'both' OR bad_status OR bad_doc""",
)
def reconcile(spark, sf_dir):
    """Order headers against what their lines say."""
    status_and_urgency = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent")))
    expected = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("owner"), status_and_urgency.alias("doc")
    )
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.when(F.min("l_linestatus") == F.max("l_linestatus"), F.min("l_linestatus")).otherwise("P").alias("status"),
        (F.max("l_linenumber") == 7).alias("urgent"),
    )
    actual = lines.select(
        F.col("l_orderkey").alias("id"),
        F.lower("status").alias("status"),
        F.to_json(F.struct("urgent", "status")).alias("doc"),
    )
    return relations.reconcile(
        expected, actual, "id", ignore=("owner",), case_blind=("status",), as_json={"doc": "status string, urgent boolean"}
    )


# --- aggregates ------------------------------------------------------------


def counter_points(events):
    """One counter point per event, named by its type."""
    return events.select("TS", F.lit("events").alias("service"), F.col("EVENT_TYPE").alias("name"), F.lit(1).alias("value"))


@query(
    "metric_counters",
    sql.with_(sql.IX_EVENTS)
    + """SELECT strftime(date_trunc('day', TS), '%Y-%m-%d') AS day, 'events' AS service, EVENT_TYPE AS name, count(*) AS total
FROM ix_events GROUP BY 1, 2, 3""",
)
def metric_counters(spark, sf_dir):
    counted = aggregates.metric_counters(counter_points(ix_events(spark, sf_dir)))
    return counted.select(F.date_format("period_start", "yyyy-MM-dd").alias("day"), "service", "name", "total")


@query(
    "duplicate_keys",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS occurrences
FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
)
def duplicate_keys(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"))
    return aggregates.duplicate_keys(keys, ["l_orderkey", "l_linenumber"])


@query(
    "nest_children",
    """WITH numbered AS (
  SELECT c_nationkey, c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 50 AS part FROM customer)
SELECT CAST(c_nationkey AS BIGINT) AS parent, part, part * 50 AS first, count(*) AS held,
       string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey) AS children
FROM numbered GROUP BY 1, 2""",
)
def nest_children(spark, sf_dir):
    nested = aggregates.nest_children(
        users(spark, sf_dir).select(F.col("NATION").alias("parent"), "USER_ID"), "parent", ["USER_ID"], part_size=50
    )
    ids = F.transform("children", lambda child: child["USER_ID"].cast("string"))
    return nested.select(
        "parent", "part", "first", F.size("children").cast("long").alias("held"), F.array_join(ids, ",").alias("children")
    )


def _marked_sql(*values: str) -> str:
    return " || ".join(f"CASE WHEN {v} IS NULL THEN 'n' ELSE length({v}) || ':' || {v} END" for v in values)


@query(
    "dataset_fingerprint",
    f"""WITH texts AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS a, CAST(o_custkey AS VARCHAR) AS b, o_orderstatus AS c,
         CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS d,
         CAST(CAST(floor(epoch(o_orderdate)) AS BIGINT) AS VARCHAR) AS e, o_orderpriority AS f FROM orders)
SELECT count(*) AS row_count, CAST(sum(CAST('0x' || substr(sha256({_marked_sql(*"abcdef")}), 1, 15) AS BIGINT))
  % 4611686018427387904 AS BIGINT) AS checksum FROM texts""",
)
def dataset_fingerprint(spark, sf_dir):
    """All columns of orders; price in cents and date in seconds, as engines print those alike."""
    orders = table(spark, sf_dir, "orders").withColumn("o_totalprice", F.round(F.col("o_totalprice") * 100).cast("long"))
    orders = orders.withColumn("o_orderdate", epoch_seconds("o_orderdate"))
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    return aggregates.fingerprint(orders, columns)


@query(
    "attribution_report",
    sql.with_(sql.IX_EVENTS)
    + f"""SELECT strftime(TS, '%Y-%m-%d') AS day, EVENT_TYPE, count(*) AS interactions, {sql.r6('sum(EVENT_VALUE)')} AS total_value
FROM ix_events GROUP BY 1, 2""",
)
def attribution_report(spark, sf_dir):
    report = aggregates.attribution_report(ix_events(spark, sf_dir))
    return report.withColumn("day", F.date_format("day", "yyyy-MM-dd")).withColumn("total_value", round6(F.col("total_value")))


# --- rules -----------------------------------------------------------------


@query(
    "dataset_rules",
    f"""WITH tagged AS (
  SELECT o_orderkey, CASE o_orderstatus
    WHEN 'F' THEN '[{{"tagKey":"priority","tagValue":"' || o_orderpriority || '"}}]'
    WHEN 'O' THEN '[]' ELSE '[{{"tagKey":"priority"}}]' END AS tags FROM orders),
labelled AS (SELECT 'batch_' || repeat(p_type, CAST(p_size AS BIGINT)) || '_2002_01_01_00_00_00' AS label FROM part)
SELECT 'interactions' AS "table", 'key_missing' AS rule,
       (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey IS NULL OR l_partkey IS NULL) AS failures
UNION ALL SELECT 'interactions', 'value_over_49',
       (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 49)
UNION ALL SELECT 'interactions', 'not_empty', 0
UNION ALL SELECT 'users', 'key_missing', (SELECT count(*) FROM customer WHERE c_custkey IS NULL)
UNION ALL SELECT 'tags', 'well_formed', (SELECT count(*) FROM tagged WHERE tags LIKE '%"tagKey"%' AND tags NOT LIKE '%"tagValue"%')
UNION ALL SELECT 'labels', 'too_long', (SELECT count(*) FROM labelled WHERE length(label) > {LABEL_LIMIT})""",
)
def dataset_rules(spark, sf_dir):
    tag = F.struct(F.lit("priority").alias("tagKey"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("tagValue"))
    tags = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderstatus") == "O", F.lit("[]")).otherwise(F.to_json(F.array(tag))).alias("tags")
    )
    names = table(spark, sf_dir, "part").select(
        F.expr("repeat(p_type, p_size)").alias("name"), F.lit("2002-01-01").cast("timestamp").alias("at")
    )
    keys_missing = F.col("USER_ID").isNull() | F.col("ITEM_ID").isNull()
    return aggregates.dataset_rules(
        {
            "interactions": ix_orders(spark, sf_dir),
            "users": users(spark, sf_dir),
            "tags": tags,
            "labels": run_label(names, "name", "at"),
        },
        [
            ("interactions", "key_missing", keys_missing),
            ("interactions", "value_over_49", F.col("EVENT_VALUE") > 49),
            ("users", "key_missing", F.col("USER_ID").isNull()),
            ("tags", "well_formed", ~aggregates.well_formed_tags("tags")),
            ("labels", "too_long", F.col("too_long")),
        ],
    )


ALLOWED = {"serviceConfig": {"name": None}, "jobs": [{"name": None}], "kind": None}


@query(
    "unexpected_keys",
    """SELECT event_id, 'note' AS key FROM events WHERE event_type = 'signup'
UNION ALL SELECT event_id, 'serviceConfig.fault' FROM events WHERE event_type = 'error'
UNION ALL SELECT event_id, 'jobs[1].price' FROM events WHERE event_type = 'purchase'""",
)
def unexpected_keys_query(spark, sf_dir):
    def only(kind: str, column: str):
        return F.when(F.col("event_type") == kind, F.col(column))

    name = F.get_json_object("props", "$.k").alias("name")
    doc = F.struct(
        F.col("event_type").alias("kind"),
        only("signup", "user_id").alias("note"),
        F.struct(name, only("error", "value").alias("fault")).alias("serviceConfig"),
        F.array(F.struct(name, F.lit(None).cast("double").alias("price")), F.struct(name, only("purchase", "value").alias("price"))).alias("jobs"),
    )
    docs = table(spark, sf_dir, "events").select("event_id", F.to_json(doc).alias("doc"))
    return unexpected_keys(docs, "doc", ALLOWED, "event_id")


# The recipe names, and the keys of a tag above.
RECIPES = """recipes AS (
  SELECT p_partkey AS id,
         CASE p_type WHEN 'ECONOMY' THEN 'recipe/sims' WHEN 'PROMO' THEN 'recipe/popularity-count'
           WHEN 'SMALL' THEN 'recipe/hrnn-coldstart' ELSE 'recipe/user-personalization' END AS recipe,
         CASE WHEN p_size > 25 THEN 'cron(0 * * * ? *)' WHEN p_size > 12 THEN '' END AS update_schedule
  FROM part)"""


@query(
    "update_supported",
    sql.with_(RECIPES)
    + """SELECT id, recipe, update_schedule FROM recipes WHERE coalesce(update_schedule, '') <> ''
  AND recipe NOT LIKE '%hrnn-coldstart%' AND recipe NOT LIKE '%user-personalization%'""",
)
def update_supported_query(spark, sf_dir):
    kind = F.col("p_type")
    recipe = (
        F.when(kind == "ECONOMY", "recipe/sims")
        .when(kind == "PROMO", "recipe/popularity-count")
        .when(kind == "SMALL", "recipe/hrnn-coldstart")
        .otherwise("recipe/user-personalization")
    )
    schedule = F.when(F.col("p_size") > 25, "cron(0 * * * ? *)").when(F.col("p_size") > 12, "")
    return update_supported(
        table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), recipe.alias("recipe"), schedule.alias("update_schedule")),
        ("hrnn-coldstart", "user-personalization"),
    )
