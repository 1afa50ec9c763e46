from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rankloom.operators.batch import batch_inference, batch_segment
from rankloom.operators.coldstart import cold_items, update_new_items
from rankloom.operators.filters import include_items
from rankloom.operators.neighbours import affinity, personalised_knn, similar_items
from rankloom.operators.segments import attribute_segments, item_segments


def r6(x):
    return math.floor(x * 1e6 + 0.5) / 1e6


def brute_similar(pairs, k):
    by_user = defaultdict(set)
    for user, item in pairs:
        by_user[user].add(item)
    n, c = Counter(), Counter()
    for held in by_user.values():
        for a in held:
            n[a] += 1
            for b in held:
                if a != b:
                    c[a, b] += 1
    out = []
    for item in n:
        scored = sorted((-r6(count / math.sqrt(n[a] * n[b])), b) for (a, b), count in c.items() if a == item)
        out += [(item, b, -s, i) for i, (s, b) in enumerate(scored[:k], start=1)]
    return sorted(out)


def brute_personal(pairs, similar, k):
    seen = set(pairs)
    score = Counter()
    near = defaultdict(list)
    for a, b, s, _ in similar:
        near[a].append((b, s))
    for user, item in seen:
        for b, s in near[item]:
            score[user, b] += s
    lists = defaultdict(list)
    for (user, item), s in score.items():
        if (user, item) not in seen:
            lists[user].append((-r6(s), item))
    return sorted((u, i, -s, r) for u, rows in lists.items() for r, (s, i) in enumerate(sorted(rows)[:k], start=1))


def as_ix(spark, pairs):
    return spark.createDataFrame([(u, i, "view") for u, i in pairs], "USER_ID long, ITEM_ID long, EVENT_TYPE string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def random_pairs(seed, users=25, items=40, rows=260):
    rng = random.Random(seed)
    pairs = [(rng.randrange(users), int(rng.paretovariate(0.7)) % items) for _ in range(rows)]
    return pairs + pairs[: rows // 10]


@pytest.mark.parametrize("threshold", [2000, 12, 6, 2, 0])
@pytest.mark.parametrize("seed", [1, 2])
def test_heavy_and_light_users_give_the_same_neighbours(spark, seed, threshold):
    pairs = random_pairs(seed)
    assert rows(similar_items(as_ix(spark, pairs), 4, threshold)) == brute_similar(pairs, 4)


def test_one_user_with_a_third_of_all_rows(spark):
    rng = random.Random(5)
    pairs = [(u, rng.randrange(120)) for u in range(60) for _ in range(10)]
    pairs += [(999, i) for i in range(300)]
    got = rows(similar_items(as_ix(spark, pairs), 5, 20))
    assert got == brute_similar(pairs, 5)


def test_heavy_users_in_many_blocks(spark):
    rng = random.Random(6)
    pairs = [(u, i) for u in range(6) for i in range(60) if rng.random() < 0.6]
    pairs += [(100 + rng.randrange(30), rng.randrange(60)) for _ in range(90)]
    assert rows(similar_items(as_ix(spark, pairs), 6, 4)) == brute_similar(pairs, 6)


@pytest.mark.parametrize("threshold", [2000, 12, 0])
def test_personal_lists_against_brute_force(spark, threshold):
    pairs = random_pairs(3)
    similar = brute_similar(pairs, 5)
    near = spark.createDataFrame(similar, "ITEM_ID long, SIMILAR_ID long, score double, rank long")
    assert rows(personalised_knn(as_ix(spark, pairs), near, 4, None, threshold)) == brute_personal(pairs, similar, 4)


def test_users_without_interactions_get_popular_items(spark):
    ix = as_ix(spark, [(1, 10), (2, 10), (2, 11), (3, 12), (3, 11), (3, 10)])
    near = similar_items(ix, 3)
    users = spark.createDataFrame([(1,), (2,), (3,), (7,), (7,)], "USER_ID long")
    cold = [r for r in rows(personalised_knn(ix, near, 2, users)) if r[0] == 7]
    assert cold == [(7, 10, 3.0, 1), (7, 11, 2.0, 2)]


def test_results_do_not_depend_on_partitions_or_order(spark):
    pairs = random_pairs(8)
    ix = as_ix(spark, pairs)
    turned = as_ix(spark, pairs[::-1]).repartition(13)
    near = similar_items(ix, 5)
    assert rows(near) == rows(similar_items(turned, 5))
    assert rows(personalised_knn(ix, near, 3)) == rows(personalised_knn(turned, near, 3))


def test_item_segments_are_cut_to_the_input(spark):
    pairs = random_pairs(9)
    ix = as_ix(spark, pairs)
    near = similar_items(ix, 5)
    wanted = spark.createDataFrame([(1,), (2,), (777,)], "ITEM_ID long")
    got = rows(item_segments(ix, near, wanted, 3))
    score = {(r.ITEM_ID, r.USER_ID): r.score for r in affinity(ix, near).collect()}
    want = []
    for item in (1, 2):
        best = sorted((-s, u) for (i, u), s in score.items() if i == item)[:3]
        want += [(item, u, -s, r) for r, (s, u) in enumerate(best, start=1)]
    assert got == sorted(want)


def test_batch_jobs_from_a_table_and_from_a_function(spark):
    ix = as_ix(spark, random_pairs(12))
    near = similar_items(ix, 5)
    people = spark.createDataFrame([(1,), (2,), (1,), (999,)], "USER_ID long")
    things = spark.createDataFrame([(3,), (4,)], "ITEM_ID long")
    scores = affinity(ix, near)
    table = rows(batch_inference(people, scores, ix, ("view",), 3))
    assert {r[0] for r in table} == {1, 2, 999}
    assert [r for r in table if r[0] == 999] == [(999, None, None, None)]
    assert table == rows(batch_inference(people, lambda asked: affinity(ix, near, users=asked), ix, ("view",), 3))
    table = rows(batch_segment(things, scores, k=3))
    assert {r[0] for r in table} == {3, 4}
    assert table == rows(batch_segment(things, lambda asked: affinity(ix, near, items=asked), k=3))


def test_attribute_segments_equal_summed_scores(spark):
    pairs = random_pairs(10)
    ix = as_ix(spark, pairs)
    near = similar_items(ix, 5)
    items = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(40)], "ITEM_ID long, GENRE string")
    values = spark.createDataFrame([("a",), ("b",)], "GENRE string")
    got = rows(attribute_segments(ix, near, items, "GENRE", values, 4))
    total = Counter()
    for r in affinity(ix, near).collect():
        total["abc"[r.ITEM_ID % 3], r.USER_ID] += r.score
    want = []
    for value in "ab":
        best = sorted((-r6(s), u) for (v, u), s in total.items() if v == value)[:4]
        want += [(value, u, -s, r) for r, (s, u) in enumerate(best, start=1)]
    assert got == sorted(want)


def test_filters_match_case_and_user(spark):
    ix = spark.createDataFrame(
        [(1, 10, "click"), (1, 11, "Click"), (2, 12, "stream"), (1, 10, "click")],
        "USER_ID long, ITEM_ID long, EVENT_TYPE string",
    )
    candidates = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 12), (2, 10)], "USER_ID long, ITEM_ID long")
    assert rows(include_items(candidates, ix, ("click", "stream"))) == [(1, 10), (2, 12)]
    assert rows(include_items(candidates, ix)) == [(1, 10), (1, 11), (2, 12)]


def test_cold_items_share_scores_by_attribute(spark):
    ix = as_ix(spark, [(1, 1), (1, 1), (1, 2), (2, 2)])
    items = spark.createDataFrame(
        [(1, "a"), (2, "b"), (5, "a"), (6, "a"), (7, "a"), (8, "b"), (9, "c")], "ITEM_ID long, GENRE string"
    )
    assert rows(cold_items(ix, items, "GENRE", 3)) == [(1, 5, 2, 1), (1, 6, 2, 2), (1, 7, 2, 3), (2, 8, 1, 1)]


def test_update_needs_new_items_and_keeps_old_rows(spark):
    ix = as_ix(spark, [(1, 1)])
    items = spark.createDataFrame([(1, "a"), (2, "a")], "ITEM_ID long, GENRE string")
    existing = spark.createDataFrame([(1, 1, 0.5, 1)], "USER_ID long, ITEM_ID long, score double, rank long")
    got = rows(update_new_items(existing, items.where("ITEM_ID = 1"), ix, items, "GENRE"))
    assert got == [(1, 1, 0.5, 1, "full"), (1, 2, 1.0, 1, "update")]
    with pytest.raises(ValueError):
        update_new_items(existing, items, ix, items, "GENRE")


def test_topk_is_cut_before_the_shuffle(spark):
    from rankloom.operators.ranking import topk

    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("ITEM_ID"), F.lit(1).alias("score"))
    plan = topk(df, 2, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan
