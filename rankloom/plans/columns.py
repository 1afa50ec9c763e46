"""Queries: column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.functions import defaults, documents, names, times
from rankloom.operators.aggregates import nest_children
from rankloom.plans import sql
from rankloom.plans.registry import query
from rankloom.plans.views import EVENTS_CUTOFF, ix_events, ntz, table
from rankloom.sources.nested import flatten_documents


@query(
    "normalise_keys",
    r"""WITH keyed AS (SELECT p_partkey, p_type || '/' || replace(p_name, ' ', '_') AS key, replace(p_name, ' ', '_') AS last FROM part),
cased AS (
  SELECT *, list_reduce(list_prepend('', list_transform(string_split(last, '_'), lambda w, i:
    CASE WHEN i = 1 THEN w ELSE upper(w[1]) || lower(w[2:]) END)), lambda a, b: a || b) AS camel FROM keyed)
SELECT p_partkey, key, p_type AS parent, last, camel,
       ltrim(lower(regexp_replace(camel, '([A-Z])', '_\1', 'g')), '_') AS snake,
       ltrim(lower(regexp_replace(camel, '([A-Z])', '-\1', 'g')), '-') AS dash,
       regexp_full_match(camel, '[a-z][A-Za-z]*') AS valid
FROM cased JOIN part USING (p_partkey)""",
)
def normalise_keys(spark, sf_dir):
    keyed = table(spark, sf_dir, "part").select(
        "p_partkey", names.compose_key(F.col("p_type"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("key")
    )
    return names.normalise_keys(keyed, "key")


@query(
    "event_time",
    sql.with_(sql.IX_EVENTS)
    + f"""SELECT "TIMESTAMP" AS seconds, strftime(to_timestamp("TIMESTAMP") AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS at,
       date_diff('microsecond', TS, TIMESTAMP '{EVENTS_CUTOFF}') // 1000000 AS elapsed
FROM ix_events""",
)
def event_time(spark, sf_dir):
    ix = ix_events(spark, sf_dir)
    timed = times.with_event_time(ix, "TIMESTAMP", "AT")
    return timed.select(
        F.col("TIMESTAMP").alias("seconds"),
        F.date_format("AT", "yyyy-MM-dd HH:mm:ss").alias("at"),
        times.elapsed_seconds(F.col("TS"), ntz(EVENTS_CUTOFF)).alias("elapsed"),
    )


@query(
    "duration_seconds",
    """WITH texts AS (
  SELECT p_partkey, p_size AS n, p_type,
         CASE p_type WHEN 'ECONOMY' THEN p_size || ' days' WHEN 'PROMO' THEN p_size || ' weeks' WHEN 'SMALL' THEN p_size || '.5 hours'
           WHEN 'LARGE' THEN 'two weeks ' || p_size || ' seconds' WHEN 'MEDIUM' THEN p_size || ' months' ELSE p_name END AS text
  FROM part)
SELECT p_partkey, text, coalesce(CAST(CASE p_type WHEN 'ECONOMY' THEN n * 86400 WHEN 'PROMO' THEN n * 604800
    WHEN 'SMALL' THEN n * 3600 + 1800 WHEN 'LARGE' THEN 1209600 + n
    WHEN 'MEDIUM' THEN date_diff('day', DATE '0001-01-01', CAST(DATE '0001-01-01' + n * INTERVAL 1 MONTH AS DATE)) * 86400 END AS BIGINT), -1) AS seconds
FROM texts""",
)
def duration_seconds(spark, sf_dir):
    kind, size = F.col("p_type"), F.col("p_size").cast("string")
    text = (
        F.when(kind == "ECONOMY", F.concat(size, F.lit(" days")))
        .when(kind == "PROMO", F.concat(size, F.lit(" weeks")))
        .when(kind == "SMALL", F.concat(size, F.lit(".5 hours")))
        .when(kind == "LARGE", F.concat(F.lit("two weeks "), size, F.lit(" seconds")))
        .when(kind == "MEDIUM", F.concat(size, F.lit(" months")))
        .otherwise(F.col("p_name"))
    )
    texts = table(spark, sf_dir, "part").select("p_partkey", text.alias("text"))
    return texts.withColumn("seconds", F.coalesce(times.duration_seconds(F.col("text")), F.lit(-1)))


@query(
    "fill_defaults",
    """SELECT event_id, CASE WHEN event_type = 'view' OR event_type = '' THEN 'unknown' ELSE event_type END AS kind,
       CASE WHEN floor(value) = 0 THEN 25 ELSE CAST(floor(value) AS BIGINT) END AS amount,
       coalesce(CASE WHEN value > 5 THEN CAST(floor(value) AS BIGINT) END, 7) AS kept
FROM events""",
)
def fill_defaults(spark, sf_dir):
    """Resolve fills empty text and zero as well; absent fills null only."""
    events = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("kind"),
        F.floor("value").alias("amount"),
        F.when(F.col("value") > 5, F.floor("value")).alias("kept"),
    )
    resolved = defaults.fill_defaults(events, {"kind": "unknown", "amount": 25})
    return defaults.fill_defaults(resolved, {"kept": 7}, mode="absent")


@query(
    "inherit_attributes",
    """SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN o_orderpriority WHEN 'O' THEN ''
    ELSE CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE '' END END AS tags
FROM orders JOIN customer ON c_custkey = o_custkey""",
)
def inherit_attributes(spark, sf_dir):
    """Tags: an order's own, an order's own empty list, or its customer's."""
    none = F.array().cast("array<string>")
    own = F.when(F.col("o_orderstatus") == "F", F.array("o_orderpriority")).when(F.col("o_orderstatus") == "O", none)
    child = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("owner"), own.alias("tags"))
    parent = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("owner"), F.when(F.col("c_acctbal") > 0, F.array("c_mktsegment")).alias("tags")
    )
    merged = defaults.inherit_attributes(child, parent, "owner", "tags")
    return merged.select("id", F.array_join("tags", ",").alias("tags"))


@query(
    "public_columns",
    "SELECT o_orderkey AS name, 'recipe/' || o_orderpriority AS recipeArn, o_totalprice AS price FROM orders",
)
def public_columns(spark, sf_dir):
    described = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("name"),
        F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")).alias("orderArn"),
        F.concat(F.lit("recipe/"), "o_orderpriority").alias("recipeArn"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("creationDateTime"),
        F.col("o_totalprice").alias("price"),
    )
    return defaults.public_columns(described)


@query(
    "json_roundtrip",
    """SELECT o_orderkey, o_orderstatus AS status, o_custkey AS owner, o_totalprice AS price, TRUE AS same,
       CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(o_totalprice AS BIGINT) ELSE -1 END AS whole,
       CASE WHEN o_totalprice = floor(o_totalprice) THEN CAST(-1 AS DOUBLE) ELSE o_totalprice END AS fractional
FROM orders""",
)
def json_roundtrip(spark, sf_dir):
    schema = "status string, owner long, price double"
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("owner"), F.col("o_totalprice").alias("price")
    )
    tripped = documents.json_roundtrip(orders, ["status", "owner", "price"], schema)
    reordered = F.to_json(F.struct("price", "owner", "status"))
    amount = F.col("price").cast("decimal(18,2)")
    return tripped.select(
        "o_orderkey",
        "decoded.*",
        documents.same_json(F.col("json"), reordered, schema).alias("same"),
        F.coalesce(documents.whole_number(amount), F.lit(-1)).alias("whole"),
        F.coalesce(documents.fractional_number(amount), F.lit(-1.0)).alias("fractional"),
    )


@query(
    "json_paths",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS item,
       CASE WHEN event_type = 'error' THEN 'late' ELSE event_type END AS kind,
       CASE WHEN event_type = 'click' THEN json_extract(props, '$.k') || ',' || event_type
            ELSE CAST(json_extract(props, '$.k') AS VARCHAR) END AS jobs,
       CASE WHEN event_type = 'click' THEN event_type ELSE '' END AS clicks
FROM events""",
)
def json_paths(spark, sf_dir):
    """Plain path, fallback path, a list of values as one flat list, and those entries a condition holds for."""
    late = F.col("event_type") == "error"
    item = F.get_json_object("props", "$.k")
    doc = F.struct(
        F.from_json("props", "k long").alias("props"),
        F.struct(F.when(late, F.lit("late")).alias("kind")).alias("update"),
        F.col("event_type").alias("kind"),
        F.array_compact(
            F.array(F.struct(item.alias("name")), F.when(F.col("event_type") == "click", F.struct(F.col("event_type").alias("name"))))
        ).alias("jobs"),
    )
    docs = table(spark, sf_dir, "events").select("event_id", F.to_json(doc).alias("doc"))
    found = documents.json_paths(docs, "doc", {"item": "$.props.k", "kind": ["$.update.kind", "$.kind"]})
    jobs = documents.json_list(F.col("doc"), "$.jobs[*].name")
    clicks = documents.json_list(
        F.col("doc"), "$.jobs[*].name", where=lambda job: F.get_json_object(job, "$.name") == "click"
    )
    return found.select(
        "event_id", "item", "kind", F.array_join(jobs, ",").alias("jobs"), F.array_join(clicks, ",").alias("clicks")
    )


@query(
    "run_label",
    """WITH labelled AS (
  SELECT o_orderkey, 'batch_' || repeat(o_orderpriority, 1 + CAST(o_custkey % 6 AS BIGINT)) || '_' ||
         strftime(o_orderdate, '%Y_%m_%d_%H_%M_%S') AS label FROM orders)
SELECT o_orderkey, label, length(label) > 63 AS too_long FROM labelled""",
)
def run_label(spark, sf_dir):
    named = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderdate", F.expr("repeat(o_orderpriority, cast(1 + o_custkey % 6 AS int))").alias("name")
    )
    return names.run_label(named, "name", "o_orderdate").select("o_orderkey", "label", "too_long")


@query(
    "flatten_documents",
    """SELECT conv_id, turn_pos, turn, role, line_pos - 1 AS line_pos, line FROM (
  SELECT conv_id, turn_pos, turn, role, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS line_pos
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_pos FROM conversations))""",
)
def flatten_documents_query(spark, sf_dir):
    """Conversations nested to JSON (turns, and lines in turns) and opened again."""
    lines = F.transform(F.split("text", "\n"), lambda line: F.struct(line.alias("line")))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", lines.alias("lines"))
    nested = nest_children(turns, "conv_id", ["turn", "role", "lines"])
    docs = nested.select("conv_id", "first", F.to_json(F.struct(F.col("children").alias("turns"))).alias("doc"))
    schema = "turns array<struct<turn: long, role: string, lines: array<struct<line: string>>>>"
    tables = flatten_documents(docs, "doc", schema, ["conv_id", "first"])
    keys = ["conv_id", "first", "turns_pos"]
    opened = tables["turns.lines"].join(tables["turns"], keys)
    turn_pos = (F.col("first") + F.col("turns_pos")).alias("turn_pos")
    return opened.select("conv_id", turn_pos, "turn", "role", F.col("lines_pos").cast("long").alias("line_pos"), "line")
