"""Queries: files in and out. Each writes a given table to the shared folder in
the layout under test and reads it back through the operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.operators.batch import batch_inference, batch_segment
from rankloom.operators.neighbours import affinity
from rankloom.operators.segments import attribute_scores
from rankloom.plans import sql
from rankloom.plans.recipes import similar_events
from rankloom.plans.registry import query
from rankloom.plans.views import ix_events, items, table, users
from rankloom.session import fresh_path
from rankloom.sources.batch_files import read_batch_input, read_batch_output, write_batch_output
from rankloom.sources.csv_files import deliver_csv, import_csv, newest_delivery, resolve_parts
from rankloom.sources.snapshots import full_import, read_snapshot

# Column and type names of the interactions and users schemas.
INTERACTIONS = {
    "type": "record",
    "name": "Interactions",
    "fields": [
        {"name": "ITEM_ID", "type": "string"},
        {"name": "USER_ID", "type": "string"},
        {"name": "TIMESTAMP", "type": "long"},
        {"name": "EVENT_TYPE", "type": "string", "categorical": True},
        {"name": "EVENT_VALUE", "type": "double"},
    ],
}
COLUMNS = ["ITEM_ID", "USER_ID", "TIMESTAMP", "EVENT_TYPE", "EVENT_VALUE"]


def _as_text(df):
    return df.select([F.col(c).cast("string").alias(c) for c in COLUMNS])


def _write_csv(df, path):
    df.write.option("header", True).csv(path)


@query(
    "import_typed_csv",
    sql.with_(sql.IX_EVENTS)
    + """SELECT CASE WHEN EVENT_TYPE = 'error' THEN 'bad' ELSE 'good' END AS outcome, CAST(USER_ID AS VARCHAR) AS "USER_ID",
       count(*) AS row_count, CAST(sum("TIMESTAMP") AS BIGINT) AS seconds
FROM ix_events GROUP BY 1, 2""",
)
def import_typed_csv(spark, sf_dir):
    """Events as CSV; those of type error carry a value that is no number."""
    path = fresh_path(spark, "csv")
    value = F.when(F.col("EVENT_TYPE") == "error", "n/a").otherwise(F.col("EVENT_VALUE"))
    _write_csv(_as_text(ix_events(spark, sf_dir)).withColumn("EVENT_VALUE", value), path)
    good, bad = import_csv(spark, path, INTERACTIONS)
    both = good.select("USER_ID", "TIMESTAMP", F.lit("good").alias("outcome")).unionByName(
        bad.select("USER_ID", F.col("TIMESTAMP").cast("long").alias("TIMESTAMP"), F.lit("bad").alias("outcome"))
    )
    return both.groupBy("outcome", "USER_ID").agg(F.count(F.lit(1)).alias("row_count"), F.sum("TIMESTAMP").alias("seconds"))


TEXTS = {
    "type": "record",
    "name": "Texts",
    "fields": [
        {"name": "ITEM_ID", "type": "long"},
        {"name": "DESCRIPTION", "type": ["null", "string"]},
        {"name": "SOURCE", "type": ["null", "string"]},
    ],
}


@query(
    "import_quoted_csv",
    """SELECT doc_id AS "ITEM_ID", source AS "SOURCE", CASE WHEN text <> '' THEN sha256(text) END AS digest,
       CASE WHEN text <> '' THEN len(text) - len(replace(text, chr(10), '')) END AS line_breaks FROM documents""",
)
def import_quoted_csv(spark, sf_dir):
    """Free text with line breaks, commas and quotes, as item metadata has it."""
    path = fresh_path(spark, "csv")
    texts = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ITEM_ID"), F.col("text").alias("DESCRIPTION"), F.col("source").alias("SOURCE")
    )
    kept = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}
    texts.write.options(header=True, **kept).csv(path)
    good, _ = import_csv(spark, path, TEXTS)
    breaks = F.length("DESCRIPTION") - F.length(F.replace("DESCRIPTION", F.lit("\n"), F.lit("")))
    return good.select("ITEM_ID", "SOURCE", F.sha2("DESCRIPTION", 256).alias("digest"), breaks.cast("long").alias("line_breaks"))


ALL_ROWS = (
    sql.with_(sql.IX_EVENTS)
    + """SELECT CAST(ITEM_ID AS VARCHAR) AS "ITEM_ID", CAST(USER_ID AS VARCHAR) AS "USER_ID", "TIMESTAMP",
       EVENT_TYPE AS "EVENT_TYPE", EVENT_VALUE AS "EVENT_VALUE" FROM ix_events"""
)


@query("union_parts", ALL_ROWS)
def union_parts(spark, sf_dir):
    """Parts with two column orders in one folder, joined up by name."""
    path = fresh_path(spark, "dataset")
    events = _as_text(ix_events(spark, sf_dir))
    _write_csv(events.where(F.col("EVENT_TYPE") != "view"), f"{path}/interactions")
    later = events.where(F.col("EVENT_TYPE") == "view").select("USER_ID", "ITEM_ID", *COLUMNS[2:])
    later.write.mode("append").option("header", True).csv(f"{path}/interactions")
    return resolve_parts(spark, path, "interactions", INTERACTIONS)


@query(
    "resolve_parts",
    sql.with_(sql.IX_EVENTS)
    + """SELECT 'folder' AS layout, EVENT_TYPE AS "EVENT_TYPE", count(*) AS row_count FROM ix_events GROUP BY 2
UNION ALL SELECT 'absent', 'none', 0""",
)
def resolve_parts_query(spark, sf_dir):
    """The interactions lie in a folder; there are no items, which is no error."""
    path = fresh_path(spark, "dataset")
    _write_csv(_as_text(ix_events(spark, sf_dir)), f"{path}/interactions")
    found = resolve_parts(spark, path, "interactions", INTERACTIONS)
    counted = found.groupBy("EVENT_TYPE").agg(F.count(F.lit(1)).alias("row_count"))
    report = counted.select(F.lit("folder").alias("layout"), "EVENT_TYPE", "row_count")
    if resolve_parts(spark, path, "items", INTERACTIONS) is None:
        absent = report.limit(1).select(F.lit("absent").alias("layout"), F.lit("none").alias("EVENT_TYPE"), F.lit(0).cast("long").alias("row_count"))
        report = report.unionByName(absent)
    return report


@query(
    "full_import",
    """SELECT c_custkey AS "USER_ID", c_mktsegment AS "SEGMENT", CAST(c_nationkey AS BIGINT) AS "NATION", CAST(2 AS BIGINT) AS version
FROM customer""",
)
def full_import_query(spark, sf_dir):
    """A second import replaces the first as a whole."""
    root = fresh_path(spark, "group")
    people = users(spark, sf_dir)
    full_import(people.where(F.col("SEGMENT") == "BUILDING"), root, "users")
    version = full_import(people, root, "users")
    return read_snapshot(spark, root, "users").withColumn("version", F.lit(version).cast("long"))


USERS = {
    "type": "record",
    "name": "Users",
    "fields": [{"name": "USER_ID", "type": "long"}, {"name": "SEGMENT", "type": "string"}],
}


@query(
    "newest_file",
    'SELECT c_custkey AS "USER_ID", c_mktsegment AS "SEGMENT" FROM customer WHERE c_custkey % 2 = 1',
)
def newest_file_query(spark, sf_dir):
    """Customers in two deliveries, one after the other; the rows of the newer one count."""
    path = fresh_path(spark, "arrivals")
    people = users(spark, sf_dir).select("USER_ID", "SEGMENT")
    for odd in (0, 1):
        deliver_csv(people.where(F.col("USER_ID") % 2 == odd), path)
    return newest_delivery(spark, path, USERS)


@query("batch_input", "SELECT c_custkey AS \"USER_ID\" FROM customer")
def batch_input(spark, sf_dir):
    return read_batch_input(spark, _user_list(spark, sf_dir), "user", "long")


def _user_list(spark, sf_dir) -> str:
    path = fresh_path(spark, "batch-input")
    table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("userId")).write.json(path)
    return path


@query(
    "batch_output",
    sql.with_(
        sql.IX_EVENTS,
        sql.similar("ix_events"),
        sql.affinity("ix_events"),
        sql.ranked("affinity", "USER_ID", "ITEM_ID", "best", 10),
    )
    + """SELECT CAST(c_custkey AS VARCHAR) AS "userId", CAST(ITEM_ID AS VARCHAR) AS id, score, rank
FROM customer LEFT JOIN best ON USER_ID = c_custkey""",
)
def batch_output(spark, sf_dir):
    """A whole inference job: JSON lines in, ranked JSON lines out."""
    out = fresh_path(spark, "batch-output")
    ix, near = ix_events(spark, sf_dir), similar_events(spark, sf_dir)
    inputs = read_batch_input(spark, _user_list(spark, sf_dir), "user", "long")
    ranked = batch_inference(inputs, lambda asked: affinity(ix, near, users=asked), k=10)
    write_batch_output(ranked, out, "USER_ID", "ITEM_ID", "userId")
    return read_batch_output(spark, out, "userId")


@query(
    "batch_segment_output",
    sql.with_(
        sql.IX_EVENTS,
        sql.similar("ix_events"),
        sql.affinity("ix_events"),
        sql.ranked("affinity", "ITEM_ID", "USER_ID", "best", 10, "ITEM_ID IN (SELECT p_partkey FROM part)"),
    )
    + """SELECT CAST(p_partkey AS VARCHAR) AS "itemId", CAST(USER_ID AS VARCHAR) AS id, score, rank
FROM part LEFT JOIN best ON ITEM_ID = p_partkey""",
)
def batch_segment_output(spark, sf_dir):
    """A whole segment job: item list in, ranked users out."""
    source, out = fresh_path(spark, "segment-input"), fresh_path(spark, "segment-output")
    items(spark, sf_dir).select(F.col("ITEM_ID").cast("string").alias("itemId")).write.json(source)
    ix, near = ix_events(spark, sf_dir), similar_events(spark, sf_dir)
    inputs = read_batch_input(spark, source, "item", "long")
    ranked = batch_segment(inputs, lambda asked: affinity(ix, near, items=asked), k=10)
    write_batch_output(ranked, out, "ITEM_ID", "USER_ID", "itemId")
    return read_batch_output(spark, out, "itemId")


@query(
    "batch_segment_attribute",
    sql.with_(
        sql.IX_EVENTS,
        sql.ITEMS,
        sql.similar("ix_events"),
        sql.affinity("ix_events"),
        f"""attribute_scores AS (
  SELECT BRAND, USER_ID, {sql.r6('sum(score)')} AS score FROM affinity JOIN items USING (ITEM_ID) GROUP BY 1, 2)""",
        sql.ranked("attribute_scores", "BRAND", "USER_ID", "best", 10),
    )
    + """SELECT b.BRAND, CAST(USER_ID AS VARCHAR) AS id, score, rank
FROM (SELECT DISTINCT p_brand AS BRAND FROM part) b LEFT JOIN best ON best.BRAND = b.BRAND""",
)
def batch_segment_attribute(spark, sf_dir):
    """A segment job by attribute: brands as JSON lines in, ranked users out."""
    source, out = fresh_path(spark, "segment-input"), fresh_path(spark, "segment-output")
    catalogue = items(spark, sf_dir)
    catalogue.select("BRAND").write.json(source)
    ix, near = ix_events(spark, sf_dir), similar_events(spark, sf_dir)
    inputs = read_batch_input(spark, source, "BRAND")
    ranked = batch_segment(inputs, lambda asked: attribute_scores(ix, near, catalogue, "BRAND", asked), k=10)
    write_batch_output(ranked, out, "BRAND", "USER_ID")
    return read_batch_output(spark, out, "BRAND")
