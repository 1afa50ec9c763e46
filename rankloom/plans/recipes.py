"""Queries: filters, recipes, batch jobs and offline metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.numeric import round6
from rankloom.operators import metrics
from rankloom.operators.batch import batch_inference, batch_segment
from rankloom.operators.coldstart import cold_items, update_new_items
from rankloom.operators.factors import fit_als, recommend_als, tune_als
from rankloom.operators.filters import include_items, training_events
from rankloom.operators.neighbours import affinity, personalised_knn, similar_items
from rankloom.operators.popularity import popular_by_views, popularity
from rankloom.operators.ranking import topk, topk_global
from rankloom.operators.relations import enrich
from rankloom.operators.segments import attribute_segments, item_segments
from rankloom.operators.training import retrain_full
from rankloom.operators.versions import serve_current
from rankloom.plans import sql
from rankloom.plans.registry import query, trained
from rankloom.plans.views import COLD_CUTOFF, ORDERS_CUTOFF, epoch_seconds, ix_events, ix_orders, items, ntz, users
from rankloom.session import fresh_path
from rankloom.sources.snapshots import read_snapshot

# --- model tables, trained once per session -------------------------------


def similar_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trained(spark, sf_dir, "similar-orders", lambda: similar_items(ix_orders(spark, sf_dir)))


def similar_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trained(spark, sf_dir, "similar-events", lambda: similar_items(ix_events(spark, sf_dir)))


def split_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return metrics.temporal_split(ix_orders(spark, sf_dir), ntz(ORDERS_CUTOFF))


def train_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal lists from the interactions before the cutoff, for all users."""

    def build() -> DataFrame:
        train, _ = split_orders(spark, sf_dir)
        near = trained(spark, sf_dir, "similar-train", lambda: similar_items(train))
        return personalised_knn(train, near, users=users(spark, sf_dir))

    return trained(spark, sf_dir, "lists-train", build)


TRAIN = f"""train AS (SELECT * FROM ix_orders WHERE TS < TIMESTAMP '{ORDERS_CUTOFF}'),
held AS (SELECT DISTINCT USER_ID, ITEM_ID FROM ix_orders WHERE TS >= TIMESTAMP '{ORDERS_CUTOFF}')"""

# --- counting recipes ------------------------------------------------------


@query(
    "popularity_count",
    sql.with_(sql.IX_EVENTS)
    + "SELECT ITEM_ID, count(*) AS score FROM ix_events GROUP BY ITEM_ID ORDER BY score DESC, ITEM_ID LIMIT 25",
)
def popularity_count(spark, sf_dir):
    return popularity(ix_events(spark, sf_dir))


@query(
    "popular_by_views",
    sql.with_(sql.IX_EVENTS)
    + """SELECT ITEM_ID, count(*) AS score FROM ix_events WHERE EVENT_TYPE = 'view'
GROUP BY ITEM_ID ORDER BY score DESC, ITEM_ID LIMIT 25""",
)
def popular_by_views_query(spark, sf_dir):
    return popular_by_views(ix_events(spark, sf_dir))


@query(
    "topk_global",
    sql.with_(sql.IX_ORDERS)
    + "SELECT ITEM_ID, sum(EVENT_VALUE) AS score FROM ix_orders GROUP BY ITEM_ID ORDER BY score DESC, ITEM_ID LIMIT 25",
)
def topk_global_query(spark, sf_dir):
    totals = ix_orders(spark, sf_dir).groupBy("ITEM_ID").agg(F.sum("EVENT_VALUE").alias("score"))
    return topk_global(totals, 25)


@query(
    "topk_per_group",
    sql.with_(
        sql.IX_ORDERS,
        "totals AS (SELECT USER_ID, ITEM_ID, sum(EVENT_VALUE) AS score FROM ix_orders GROUP BY 1, 2)",
        sql.ranked("totals", "USER_ID", "ITEM_ID", "best", 5),
    )
    + "SELECT * FROM best",
)
def topk_per_group(spark, sf_dir):
    totals = ix_orders(spark, sf_dir).groupBy("USER_ID", "ITEM_ID").agg(F.sum("EVENT_VALUE").alias("score"))
    return topk(totals, 5, by=["USER_ID"])


@query(
    "training_events",
    sql.with_(sql.IX_EVENTS)
    + f"""SELECT ITEM_ID, count(*) AS interactions, {sql.r6('sum(EVENT_VALUE)')} AS total_value
FROM ix_events WHERE EVENT_TYPE = 'purchase' GROUP BY ITEM_ID""",
)
def training_events_query(spark, sf_dir):
    chosen = training_events(ix_events(spark, sf_dir), "purchase")
    return chosen.groupBy("ITEM_ID").agg(
        F.count(F.lit(1)).alias("interactions"), round6(F.sum("EVENT_VALUE")).alias("total_value")
    )


@query(
    "enrich_interactions",
    sql.with_(sql.IX_ORDERS, sql.ITEMS, sql.USERS)
    + """SELECT USER_ID, ITEM_ID, CAST(floor(epoch(TS)) AS BIGINT) AS "TIMESTAMP", EVENT_TYPE, EVENT_VALUE,
       TYPE, BRAND, SEGMENT, NATION
FROM ix_orders LEFT JOIN items USING (ITEM_ID) LEFT JOIN users USING (USER_ID)""",
)
def enrich_interactions(spark, sf_dir):
    ix = ix_orders(spark, sf_dir).withColumn("TIMESTAMP", epoch_seconds("TS")).drop("TS")
    return enrich(ix, items(spark, sf_dir), users(spark, sf_dir))


# --- neighbours, personal lists, segments ---------------------------------


@query(
    "similar_items",
    sql.with_(sql.IX_ORDERS, sql.similar("ix_orders")) + "SELECT ITEM_ID, SIMILAR_ID, score, rank FROM nearby",
)
def similar_items_query(spark, sf_dir):
    return similar_orders(spark, sf_dir)


@query(
    "personalised_knn",
    sql.with_(
        sql.IX_ORDERS, sql.USERS, sql.similar("ix_orders"), sql.affinity("ix_orders"), sql.personal("ix_orders", "users")
    )
    + "SELECT USER_ID, ITEM_ID, score, rank FROM lists",
)
def personalised_knn_query(spark, sf_dir):
    return personalised_knn(ix_orders(spark, sf_dir), similar_orders(spark, sf_dir), users=users(spark, sf_dir))


@query(
    "personalised_knn_events",
    sql.with_(
        sql.IX_EVENTS, sql.USERS, sql.similar("ix_events"), sql.affinity("ix_events"), sql.personal("ix_events", "users")
    )
    + "SELECT USER_ID, ITEM_ID, score, rank FROM lists",
)
def personalised_knn_events(spark, sf_dir):
    """Most customers have no events, so this one shows the popular fallback."""
    return personalised_knn(ix_events(spark, sf_dir), similar_events(spark, sf_dir), users=users(spark, sf_dir))


def _included(where: str) -> str:
    return (
        sql.with_(sql.IX_EVENTS, sql.similar("ix_events"), sql.affinity("ix_events"))
        + f"""SELECT USER_ID, ITEM_ID, score FROM affinity a WHERE EXISTS (
  SELECT 1 FROM ix_events x WHERE x.USER_ID = a.USER_ID AND x.ITEM_ID = a.ITEM_ID AND {where})"""
    )


@query("filter_include_types", _included("x.EVENT_TYPE IN ('click', 'view')"))
def filter_include_types(spark, sf_dir):
    ix = ix_events(spark, sf_dir)
    return include_items(affinity(ix, similar_events(spark, sf_dir)), ix, ("click", "view"))


@query("filter_include_any", _included("TRUE"))
def filter_include_any(spark, sf_dir):
    ix = ix_events(spark, sf_dir)
    return include_items(affinity(ix, similar_events(spark, sf_dir)), ix)


@query(
    "item_affinity_segment",
    sql.with_(
        sql.IX_ORDERS,
        sql.similar("ix_orders"),
        sql.affinity("ix_orders"),
        sql.ranked("affinity", "ITEM_ID", "USER_ID", "segments", where="ITEM_ID IN (SELECT p_partkey FROM part)"),
    )
    + "SELECT * FROM segments",
)
def item_affinity_segment(spark, sf_dir):
    return item_segments(ix_orders(spark, sf_dir), similar_orders(spark, sf_dir), items(spark, sf_dir))


ATTRIBUTE_SCORES = f"""attribute_scores AS (
  SELECT BRAND, USER_ID, {sql.r6('sum(score)')} AS score FROM affinity JOIN items USING (ITEM_ID) GROUP BY 1, 2)"""


@query(
    "attribute_affinity_segment",
    sql.with_(
        sql.IX_ORDERS,
        sql.ITEMS,
        sql.similar("ix_orders"),
        sql.affinity("ix_orders"),
        ATTRIBUTE_SCORES,
        sql.ranked("attribute_scores", "BRAND", "USER_ID", "segments"),
    )
    + "SELECT * FROM segments",
)
def attribute_affinity_segment(spark, sf_dir):
    catalogue = items(spark, sf_dir)
    brands = catalogue.select("BRAND")
    return attribute_segments(ix_orders(spark, sf_dir), similar_orders(spark, sf_dir), catalogue, "BRAND", brands)


@query(
    "batch_inference",
    sql.with_(
        sql.IX_EVENTS,
        sql.similar("ix_events"),
        sql.affinity("ix_events"),
        sql.ranked(
            "affinity",
            "USER_ID",
            "ITEM_ID",
            "best",
            10,
            """USER_ID IN (SELECT c_custkey FROM customer) AND EXISTS (SELECT 1 FROM ix_events x
      WHERE x.USER_ID = affinity.USER_ID AND x.ITEM_ID = affinity.ITEM_ID AND x.EVENT_TYPE = 'purchase')""",
        ),
    )
    + "SELECT c_custkey AS USER_ID, ITEM_ID, score, rank FROM customer LEFT JOIN best ON USER_ID = c_custkey",
)
def batch_inference_query(spark, sf_dir):
    ix = ix_events(spark, sf_dir)
    near = similar_events(spark, sf_dir)
    people = users(spark, sf_dir).select("USER_ID")
    return batch_inference(people, lambda asked: affinity(ix, near, users=asked), ix, ("purchase",), 10)


@query(
    "batch_segment",
    sql.with_(
        sql.IX_EVENTS,
        sql.similar("ix_events"),
        sql.affinity("ix_events"),
        sql.ranked("affinity", "ITEM_ID", "USER_ID", "best", 10, "ITEM_ID IN (SELECT p_partkey FROM part)"),
    )
    + "SELECT p_partkey AS ITEM_ID, USER_ID, score, rank FROM part LEFT JOIN best ON ITEM_ID = p_partkey",
)
def batch_segment_query(spark, sf_dir):
    ix = ix_events(spark, sf_dir)
    near = similar_events(spark, sf_dir)
    return batch_segment(items(spark, sf_dir).select("ITEM_ID"), lambda asked: affinity(ix, near, items=asked), k=10)


# --- new items, versions, pointers ----------------------------------------

EARLY = f"early AS (SELECT * FROM ix_orders WHERE TS < TIMESTAMP '{COLD_CUTOFF}')"
COLD_SCORES = """fresh AS (SELECT ITEM_ID, BRAND FROM items WHERE ITEM_ID NOT IN (SELECT ITEM_ID FROM early)),
profile AS (SELECT USER_ID, BRAND, count(*) AS score FROM early JOIN items USING (ITEM_ID) GROUP BY 1, 2),
cold_scores AS (SELECT USER_ID, ITEM_ID, score FROM profile JOIN fresh USING (BRAND))"""


def _early(spark, sf_dir):
    return ix_orders(spark, sf_dir).where(F.col("TS") < ntz(COLD_CUTOFF))


@query(
    "cold_items",
    sql.with_(
        sql.IX_ORDERS, sql.ITEMS, EARLY, COLD_SCORES, sql.ranked("cold_scores", "USER_ID", "ITEM_ID", "best")
    )
    + "SELECT * FROM best",
)
def cold_items_query(spark, sf_dir):
    return cold_items(_early(spark, sf_dir), items(spark, sf_dir), "BRAND")


@query(
    "update_new_items",
    sql.with_(
        sql.IX_ORDERS,
        sql.ITEMS,
        EARLY,
        COLD_SCORES,
        sql.ranked("cold_scores", "USER_ID", "ITEM_ID", "best"),
        "totals AS (SELECT USER_ID, ITEM_ID, count(*) AS score FROM early GROUP BY 1, 2)",
        sql.ranked("totals", "USER_ID", "ITEM_ID", "existing"),
    )
    + "SELECT *, 'full' AS origin FROM existing UNION ALL SELECT *, 'update' FROM best",
)
def update_new_items_query(spark, sf_dir):
    early, catalogue = _early(spark, sf_dir), items(spark, sf_dir)
    totals = early.groupBy("USER_ID", "ITEM_ID").agg(F.count(F.lit(1)).alias("score"))
    existing = topk(totals, 25, by=["USER_ID"])
    return update_new_items(existing, early.select("ITEM_ID"), early, catalogue, "BRAND")


@query(
    "retrain_full",
    sql.with_(
        sql.IX_ORDERS,
        "totals AS (SELECT EVENT_TYPE, ITEM_ID, count(*) AS score FROM ix_orders GROUP BY 1, 2)",
        sql.ranked("totals", "EVENT_TYPE", "ITEM_ID", "best"),
    )
    + "SELECT *, CAST(2 AS BIGINT) AS version FROM best",
)
def retrain_full_query(spark, sf_dir):
    """Trains, is told that version 1 is current, and is then forced to 2."""
    root = fresh_path(spark, "solutions")
    ix = ix_orders(spark, sf_dir)

    def recipe(data: DataFrame) -> DataFrame:
        totals = data.groupBy("EVENT_TYPE", "ITEM_ID").agg(F.count(F.lit(1)).alias("score"))
        return topk(totals, 25, by=["EVENT_TYPE"])

    retrain_full(ix, recipe, root, "popular-by-type")
    if retrain_full(ix, recipe, root, "popular-by-type", max_age=86400) is not None:
        raise ValueError("a version younger than a day was trained again")
    version = retrain_full(ix, recipe, root, "popular-by-type", max_age=86400, force=True)
    return read_snapshot(spark, root, "popular-by-type").withColumn("version", F.lit(version).cast("long"))


@query(
    "serve_current",
    sql.with_(
        sql.IX_ORDERS,
        "totals AS (SELECT EVENT_TYPE, ITEM_ID, count(*) AS score FROM ix_orders GROUP BY 1, 2)",
        sql.ranked("totals", "EVENT_TYPE", "ITEM_ID", "best"),
    )
    + """SELECT 'solution-' || EVENT_TYPE AS solution, CAST(1 AS BIGINT) AS version, 'campaign-' || EVENT_TYPE AS name,
       ITEM_ID, score, rank FROM best""",
)
def serve_current_query(spark, sf_dir):
    """Version 1 ranks by number of orders, version 2 by quantity; every
    campaign points to version 1 of its solution."""
    per_item = ix_orders(spark, sf_dir).groupBy("EVENT_TYPE", "ITEM_ID")
    totals = per_item.agg(F.count(F.lit(1)).alias("orders"), F.sum("EVENT_VALUE").cast("long").alias("quantity"))
    both = totals.unpivot(["EVENT_TYPE", "ITEM_ID"], ["orders", "quantity"], "measure", "score")
    ranked = topk(both, 25, by=["EVENT_TYPE", "measure"])
    results = ranked.select(
        F.concat(F.lit("solution-"), "EVENT_TYPE").alias("solution"),
        F.when(F.col("measure") == "orders", 1).otherwise(2).cast("long").alias("version"),
        "ITEM_ID",
        "score",
        "rank",
    )
    kinds = ix_orders(spark, sf_dir).select("EVENT_TYPE").distinct()
    pointers = kinds.select(
        F.concat(F.lit("campaign-"), "EVENT_TYPE").alias("name"),
        F.concat(F.lit("solution-"), "EVENT_TYPE").alias("solution"),
        F.concat(F.lit("solution-"), "EVENT_TYPE", F.lit("/1")).alias("version_key"),
    )
    return serve_current(results, pointers)


# --- latent factors --------------------------------------------------------


def _als_lists(spark, sf_dir):
    train, _ = split_orders(spark, sf_dir)
    return trained(spark, sf_dir, "lists-als", lambda: recommend_als(fit_als(train), train, users=users(spark, sf_dir)))


@query("personalised_als")
def personalised_als(spark, sf_dir):
    """Lists for everyone. They hang on the factors; ``personalised_als_ranks`` checks what does not."""
    return _als_lists(spark, sf_dir)


@query(
    "personalised_als_ranks",
    sql.with_(
        sql.IX_ORDERS,
        sql.USERS,
        TRAIN,
        "seen AS (SELECT USER_ID, count(DISTINCT ITEM_ID) AS held FROM train GROUP BY 1)",
        "goods AS (SELECT count(DISTINCT ITEM_ID) AS n FROM train)",
    )
    + """SELECT USER_ID, r AS rank, FALSE AS seen_before
FROM users LEFT JOIN seen USING (USER_ID), goods, range(1, 26) t(r) WHERE r <= n - coalesce(held, 0)""",
)
def personalised_als_ranks(spark, sf_dir):
    """What does not hang on the factors: whole lists for everyone, without seen items."""
    train, _ = split_orders(spark, sf_dir)
    marks = train.select("USER_ID", "ITEM_ID").distinct().withColumn("seen", F.lit(True))
    marked = _als_lists(spark, sf_dir).join(marks, ["USER_ID", "ITEM_ID"], "left")
    return marked.select("USER_ID", "rank", F.coalesce("seen", F.lit(False)).alias("seen_before"))


def _tuned(spark, sf_dir):
    train, held = split_orders(spark, sf_dir)
    grid = {"rank": [5, 10], "regParam": [0.05, 0.5]}
    return trained(spark, sf_dir, "tuned-als", lambda: tune_als(train, held, grid))


@query("tune_als")
def tune_als_query(spark, sf_dir):
    """The settings of the grid with their NDCG on the held-out orders."""
    return _tuned(spark, sf_dir)


@query(
    "tune_als_settings",
    """SELECT CAST(r AS DOUBLE) AS rank, CAST(p AS DOUBLE) AS "regParam", TRUE AS in_range
FROM (VALUES (5), (10)) a(r), (VALUES (0.05), (0.5)) b(p)""",
)
def tune_als_settings(spark, sf_dir):
    """Every setting is there, with a figure between 0 and 1."""
    return _tuned(spark, sf_dir).select("rank", "regParam", F.col("ndcg_at_25").between(0, 1).alias("in_range"))


# --- offline metrics -------------------------------------------------------


@query(
    "temporal_split",
    sql.with_(sql.IX_ORDERS, TRAIN)
    + """SELECT 'train' AS part, USER_ID, ITEM_ID, count(*) AS interactions FROM train GROUP BY 1, 2, 3
UNION ALL SELECT 'held', USER_ID, ITEM_ID, 1 FROM held""",
)
def temporal_split_query(spark, sf_dir):
    train, held = split_orders(spark, sf_dir)
    counted = train.groupBy("USER_ID", "ITEM_ID").agg(F.count(F.lit(1)).alias("interactions"))
    return counted.select(F.lit("train").alias("part"), "*").unionByName(
        held.select(F.lit("held").alias("part"), "*", F.lit(1).cast("long").alias("interactions"))
    )


def _metric_sql(select: str) -> str:
    gains = ", ".join(
        f"sum(CASE WHEN rank <= {d} THEN 1 / log2(rank + 1) ELSE 0 END) AS gain_{d}" for d in metrics.NDCG_DEPTHS
    )
    hits = ", ".join(f"sum(CASE WHEN rank <= {d} THEN 1 ELSE 0 END) AS hits_{d}" for d in metrics.PRECISION_DEPTHS)
    ideal = ", ".join(
        f"(SELECT sum(1 / log2(r + 1)) FROM range(1, 26) t(r) WHERE r <= least(relevant, {d})) AS ideal_{d}"
        for d in metrics.NDCG_DEPTHS
    )
    return (
        sql.with_(
            sql.IX_ORDERS,
            sql.USERS,
            TRAIN,
            sql.similar("train"),
            sql.affinity("train"),
            sql.personal("train", "users"),
            f"""per_user AS (
  SELECT held.USER_ID, count(*) AS relevant, min(rank) AS first_hit, {gains}, {hits}
  FROM held LEFT JOIN lists ON lists.USER_ID = held.USER_ID AND lists.ITEM_ID = held.ITEM_ID GROUP BY 1)""",
            f"judged AS (SELECT *, {ideal} FROM per_user)",
        )
        + select
    )


MRR = sql.r6("avg(coalesce(1 / CAST(first_hit AS DOUBLE), 0))")
COVERAGE = sql.r6(
    "(SELECT count(DISTINCT ITEM_ID) FROM lists) / CAST((SELECT count(DISTINCT ITEM_ID) FROM train) AS DOUBLE)"
)


def _ndcg(depth: int) -> str:
    return sql.r6(f"avg(gain_{depth} / ideal_{depth})")


def _precision(depth: int) -> str:
    return sql.r6(f"avg(hits_{depth} / CAST({depth} AS DOUBLE))")


@query("coverage", _metric_sql(f"SELECT {COVERAGE} AS coverage"))
def coverage_query(spark, sf_dir):
    train, _ = split_orders(spark, sf_dir)
    return metrics.coverage(train_lists(spark, sf_dir), train)


def _rank_metric(name: str):
    def run(spark, sf_dir):
        _, held = split_orders(spark, sf_dir)
        return metrics.rank_metrics(train_lists(spark, sf_dir), held).select(F.col(name).alias("value"))

    return run


query("mrr_at_25", _metric_sql(f"SELECT {MRR} AS value FROM judged"))(_rank_metric("mean_reciprocal_rank_at_25"))
for depth in metrics.NDCG_DEPTHS:
    query(f"ndcg_at_{depth}", _metric_sql(f"SELECT {_ndcg(depth)} AS value FROM judged"))(
        _rank_metric(f"normalized_discounted_cumulative_gain_at_{depth}")
    )
for depth in metrics.PRECISION_DEPTHS:
    query(f"precision_at_{depth}", _metric_sql(f"SELECT {_precision(depth)} AS value FROM judged"))(
        _rank_metric(f"precision_at_{depth}")
    )

ALL_METRICS = [
    ("coverage", f"(SELECT {COVERAGE})"),
    ("mean_reciprocal_rank_at_25", f"(SELECT {MRR} FROM judged)"),
    *[(f"normalized_discounted_cumulative_gain_at_{d}", f"(SELECT {_ndcg(d)} FROM judged)") for d in metrics.NDCG_DEPTHS],
    *[(f"precision_at_{d}", f"(SELECT {_precision(d)} FROM judged)") for d in metrics.PRECISION_DEPTHS],
]


@query(
    "metrics_by_version",
    _metric_sql(
        "\nUNION ALL ".join(
            f"SELECT 'personal' AS solution, CAST(1 AS BIGINT) AS version, '{name}' AS name, {value} AS value"
            for name, value in ALL_METRICS
        )
    ),
)
def metrics_by_version_query(spark, sf_dir):
    train, held = split_orders(spark, sf_dir)
    long = metrics.offline_metrics(train_lists(spark, sf_dir), held, train)
    return metrics.metrics_by_version(long, "personal", 1)
