from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from rankloom.operators import factors, metrics
from rankloom.operators.factors import dense_index, fit_als, recommend_als, tune_als
from rankloom.operators.popularity import popularity


def lists_of(spark, lists):
    rows = [(u, i, r) for u, items in lists.items() for r, i in enumerate(items, start=1)]
    return spark.createDataFrame(rows, "USER_ID long, ITEM_ID long, rank long")


def held_of(spark, held):
    return spark.createDataFrame([(u, i) for u, items in held.items() for i in items], "USER_ID long, ITEM_ID long")


def brute(lists, held):
    total = {}
    for user, relevant in held.items():
        ranked = lists.get(user, [])
        ranks = [r for r, i in enumerate(ranked[:25], start=1) if i in relevant]
        values = {"mean_reciprocal_rank_at_25": 1 / ranks[0] if ranks else 0.0}
        for d in (5, 10, 25):
            ideal = sum(1 / math.log2(r + 1) for r in range(1, min(len(relevant), d) + 1))
            values[f"normalized_discounted_cumulative_gain_at_{d}"] = sum(1 / math.log2(r + 1) for r in ranks if r <= d) / ideal
            values[f"precision_at_{d}"] = sum(r <= d for r in ranks) / d
        for name, value in values.items():
            total[name] = total.get(name, 0) + value / len(held)
    return total


def test_metrics_against_brute_force(spark):
    rng = random.Random(4)
    lists = {u: rng.sample(range(60), rng.choice([0, 3, 25])) for u in range(40)}
    held = {u: set(rng.sample(range(60), rng.choice([1, 4, 30]))) for u in range(10, 60)}
    got = metrics.rank_metrics(lists_of(spark, lists), held_of(spark, held)).first().asDict()
    want = brute(lists, held)
    assert got.keys() == want.keys()
    for name in want:
        assert got[name] == pytest.approx(want[name], abs=1e-6)


def test_all_eight_metrics_and_coverage(spark):
    long = metrics.offline_metrics(
        lists_of(spark, {1: [10, 11]}), held_of(spark, {1: {11}}), spark.createDataFrame([(i,) for i in (10, 11, 12, 13)], "ITEM_ID long")
    )
    values = {r.name: r.value for r in metrics.metrics_by_version(long, "s", 3).collect()}
    assert len(values) == 8
    assert values["coverage"] == 0.5
    assert values["mean_reciprocal_rank_at_25"] == 0.5
    assert values["precision_at_5"] == 0.2


def test_ndcg_agrees_with_spark_ml(spark):
    from pyspark.ml.evaluation import RankingEvaluator

    lists = {u: [(u * 7 + r) % 30 for r in range(10)] for u in range(20)}
    held = {u: {(u * 5 + r) % 30 for r in range(12)} for u in range(20)}
    rows = [([float(i) for i in lists[u]], [float(i) for i in held[u]]) for u in lists]
    df = spark.createDataFrame(rows, "prediction array<double>, label array<double>")
    ours = metrics.rank_metrics(lists_of(spark, lists), held_of(spark, held)).first()
    precision = RankingEvaluator(metricName="precisionAtK", k=10).evaluate(df)
    ndcg = RankingEvaluator(metricName="ndcgAtK", k=10).evaluate(df)
    assert ours["precision_at_10"] == pytest.approx(precision, abs=1e-6)
    assert ours["normalized_discounted_cumulative_gain_at_10"] == pytest.approx(ndcg, abs=1e-6)


@pytest.fixture(scope="module")
def planted(spark):
    """Two groups of users, each choosing mostly from its own half of the items."""
    rng = random.Random(11)
    rows = []
    for user in range(60):
        own = range(0, 40) if user % 2 else range(40, 80)
        for item in rng.sample(own, 22):
            rows.append((user, item, rng.random()))
        rows.append((user, rng.randrange(80), rng.random()))
    ix = spark.createDataFrame(rows, "USER_ID long, ITEM_ID long, at double")
    train = ix.where("at < 0.7").select("USER_ID", "ITEM_ID").cache()
    held = ix.where("at >= 0.7").select("USER_ID", "ITEM_ID").distinct().join(train, ["USER_ID", "ITEM_ID"], "left_anti")
    return train, held


def test_factors_find_planted_groups(spark, planted):
    train, held = planted
    personal = recommend_als(fit_als(train, {"alpha": 10.0}), train, 25)
    assert personal.join(train, ["USER_ID", "ITEM_ID"], "left_semi").isEmpty()
    top = popularity(train, 25).collect()
    users = [r.USER_ID for r in train.select("USER_ID").distinct().collect()]
    same = lists_of(spark, {u: [r.ITEM_ID for r in top] for u in users})

    def ndcg(lists):
        return metrics.rank_metrics(lists, held).first()["normalized_discounted_cumulative_gain_at_25"]

    assert ndcg(personal) > ndcg(same)


def test_cold_users_get_the_popular_list(spark, planted):
    train, _ = planted
    asked = spark.createDataFrame([(1,), (999,)], "USER_ID long")
    lists = recommend_als(fit_als(train), train, 5, asked)
    got = {u: [r.ITEM_ID for r in lists.where(F.col("USER_ID") == u).orderBy("rank").collect()] for u in (1, 999)}
    assert len(got[1]) == 5 and got[999] == [r.ITEM_ID for r in popularity(train, 5).collect()]
    assert lists.select("USER_ID").distinct().count() == 2


def test_tuning_reports_every_setting(spark, planted):
    train, held = planted
    got = tune_als(train, held, {"rank": [2, 4], "regParam": [0.1]}).collect()
    assert sorted(r.rank for r in got) == [2.0, 4.0]
    assert got[0].ndcg_at_25 >= got[1].ndcg_at_25
    asked = held.select("USER_ID").distinct()
    for row in got:  # each setting alone
        lists = recommend_als(fit_als(train, {"rank": int(row["rank"]), "regParam": row.regParam}), train, 25, asked)
        alone = metrics.rank_metrics(lists, held).first()["normalized_discounted_cumulative_gain_at_25"]
        assert abs(alone - row.ndcg_at_25) < 1e-6


def test_a_fit_has_more_blocks_for_more_ratings(spark, planted, monkeypatch):
    train, _ = planted
    assert fit_als(train, {"maxIter": 1}).model.itemFactors.rdd.getNumPartitions() == 10  # few ratings, as in Spark
    monkeypatch.setattr(factors, "BLOCK_RATINGS", 80, raising=False)
    given, fit = [], factors.ALS.fit
    monkeypatch.setattr(factors.ALS, "fit", lambda als, rows: (given.append(rows.rdd.getNumPartitions()), fit(als, rows))[1])
    model = fit_als(train, {"maxIter": 1}).model
    blocks = math.ceil(train.distinct().count() / 80)
    assert blocks > 10
    assert [model.userFactors.rdd.getNumPartitions(), model.itemFactors.rdd.getNumPartitions(), *given] == [blocks] * 3
    assert model.userFactors.count() == train.select("USER_ID").distinct().count()


def test_large_fits_of_a_search_go_one_after_the_other(spark, planted, monkeypatch):
    train, held = planted
    monkeypatch.setattr(factors, "BLOCK_RATINGS", 80, raising=False)
    monkeypatch.setattr(factors, "FREED_EVERY", 1, raising=False)
    running, most, fit = [], [], factors.fit_ratings

    def watched(ratings, params=None):
        running.append(params)
        most.append(len(running))
        try:
            return fit(ratings, params)
        finally:
            running.remove(params)

    with monkeypatch.context() as patched:
        patched.setattr(factors, "fit_ratings", watched)
        got = tune_als(train, held, {"rank": [2, 4], "maxIter": [2]}).collect()
    assert most == [1, 1]
    asked = held.select("USER_ID").distinct()
    for row in got:  # each setting alone
        lists = recommend_als(fit_als(train, {"rank": int(row["rank"]), "maxIter": 2}), train, 25, asked)
        alone = metrics.rank_metrics(lists, held).first()["normalized_discounted_cumulative_gain_at_25"]
        assert abs(alone - row.ndcg_at_25) < 1e-6


def test_dense_index_is_dense(spark):
    df = spark.range(1000).select((F.col("id") % 137 * 1000).alias("x")).repartition(11)
    rows = dense_index(df, "x", "x").collect()
    assert sorted(r["index"] for r in rows) == list(range(137))
    assert len({r.x for r in rows}) == 137
    assert [r.x for r in sorted(rows, key=lambda r: r["index"])] == [1000 * k for k in range(137)]
