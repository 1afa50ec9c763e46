from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from rankloom.operators import in_tasks, neighbours, segments
from test_neighbours import as_ix, brute_personal, brute_similar, random_pairs, rows


def operators(df):
    """Names of the physical operators from the result down."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"\b(Exchange|MapInArrow|Generate|Window)\b", plan)


def test_pairs_and_contributions_are_not_shuffled(spark, monkeypatch):
    """Whatever is shuffled is shuffled before lists are unfolded."""
    ix = as_ix(spark, random_pairs(1))
    lists = neighbours.similar_items(ix, 4)
    assert operators(lists)[0] == "MapInArrow"
    near = spark.createDataFrame(lists.collect(), lists.schema)
    assert operators(neighbours.personalised_knn(ix, near, 3))[0] == "MapInArrow"


def test_many_small_tasks(spark, monkeypatch):
    monkeypatch.setattr(in_tasks, "PAIRS", 50)
    monkeypatch.setattr(neighbours, "CONTRIBUTIONS", 40)
    pairs = random_pairs(4)
    similar = neighbours.similar_items(as_ix(spark, pairs), 5)
    assert rows(similar) == brute_similar(pairs, 5)
    near = spark.createDataFrame(similar.collect(), similar.schema)
    assert rows(neighbours.personalised_knn(as_ix(spark, pairs), near, 4)) == brute_personal(pairs, rows(near), 4)


@pytest.mark.parametrize("kind", ["text", "far"])
def test_ids_of_other_kinds(spark, kind):
    """Texts, and longs that fit no int: the order of ties is that of the ids."""
    named = (lambda i: f"item {i}") if kind == "text" else (lambda i: i * 10**11 - 5)
    pairs = [(u, named(i)) for u, i in random_pairs(2)]
    ix = spark.createDataFrame(pairs, f"USER_ID long, ITEM_ID {'string' if kind == 'text' else 'long'}")
    similar = neighbours.similar_items(ix, 5)
    assert rows(similar) == brute_similar(pairs, 5)
    near = spark.createDataFrame(similar.collect(), similar.schema)
    assert rows(neighbours.personalised_knn(ix, near, 4)) == brute_personal(pairs, rows(near), 4)


def test_null_keys(spark):
    """A row without user counts for its item but makes no pair; one without item makes nothing."""
    ix = spark.createDataFrame([(1, 1), (1, 2), (None, 1), (None, 3), (2, None), (2, 2)], "USER_ID long, ITEM_ID long")
    near = neighbours.similar_items(ix, 3)
    assert rows(near) == [(1, 2, 0.5, 1), (2, 1, 0.5, 1)]
    lists = neighbours.personalised_knn(ix, near, 3)
    assert sorted(map(tuple, lists.collect()), key=str) == [(2, 1, 0.5, 1), (None, 2, 0.5, 1)]


def test_scores_of_any_size(spark):
    near = spark.createDataFrame([(1, 2, 0.1234567, 1), (1, 3, 1e7, 2), (4, 2, 0.0000004, 1)], "ITEM_ID long, SIMILAR_ID long, score double, rank long")
    ix = spark.createDataFrame([(1, 1), (1, 4), (2, 9)], "USER_ID long, ITEM_ID long")
    assert rows(neighbours.personalised_knn(ix, near, 3)) == [(1, 2, 0.123457, 2), (1, 3, 1e7, 1)]


def test_a_very_frequent_item(spark):
    pairs = [(u, i) for u in range(400) for i in (7, u % 50 + 10)]
    assert rows(neighbours.similar_items(as_ix(spark, pairs), 5)) == brute_similar(pairs, 5)


def test_no_rows(spark):
    empty = spark.createDataFrame([], "USER_ID long, ITEM_ID long, EVENT_TYPE string")
    near = neighbours.similar_items(empty, 3)
    assert near.count() == 0
    assert neighbours.personalised_knn(empty, near, 3).count() == 0


def brute_users(pairs, similar):
    """Affinity of each user to each item, in millionths."""
    total = Counter()
    for user, item in set(pairs):
        for a, b, score, _ in similar:
            if a == item:
                total[user, b] += round(score * 1e6)
    return total


def best_first(total, k):
    groups = defaultdict(list)
    for (user, group), score in total.items():
        groups[group].append((-score, user))
    return sorted((g, u, -s / 1e6, r) for g, found in groups.items() for r, (s, u) in enumerate(sorted(found)[:k], start=1))


@pytest.mark.parametrize("hot", [1_000_000, 30])
def test_segments_of_items(spark, monkeypatch, hot):
    monkeypatch.setattr(segments, "HOT", hot)
    monkeypatch.setattr(segments, "LIST", 3)
    monkeypatch.setattr(segments, "CONTRIBUTIONS", 40)
    pairs = random_pairs(5)
    near = brute_similar(pairs, 6)
    similar = spark.createDataFrame(near, "ITEM_ID long, SIMILAR_ID long, score double, rank long")
    wanted = spark.createDataFrame([(i,) for i in range(30)], "ITEM_ID long")
    got = segments.item_segments(as_ix(spark, pairs), similar, wanted, 4)
    assert rows(got) == [r for r in best_first(brute_users(pairs, near), 4) if r[0] < 30]
    if hot > 30:
        assert operators(got)[0] == "MapInArrow"


@pytest.mark.parametrize("heavy", [2000, 5])
def test_segments_of_values(spark, monkeypatch, heavy):
    monkeypatch.setattr(segments, "CONTRIBUTIONS", 40)
    pairs = random_pairs(6)
    near = brute_similar(pairs, 6)
    similar = spark.createDataFrame(near, "ITEM_ID long, SIMILAR_ID long, score double, rank long")
    goods = spark.createDataFrame([(i, f"b{i % 4}") for i in range(40)] + [(40, None)], "ITEM_ID long, BRAND string")
    asked = spark.createDataFrame([("b1",), ("b2",), ("b2",), ("none",), (None,)], "BRAND string")
    total = Counter()
    for (user, item), score in brute_users(pairs, near).items():
        if item % 4 in (1, 2):
            total[user, f"b{item % 4}"] += score
    got = segments.attribute_segments(as_ix(spark, pairs), similar, goods, "BRAND", asked, 5, heavy)
    assert rows(got) == best_first(total, 5)
    if heavy == 2000:
        assert "MapInArrow" in operators(got)


def test_several_rounds(spark, monkeypatch):
    """Blocks and users in parts give what they give at once, and a round's shuffle is gone when it is written."""
    monkeypatch.setattr(in_tasks, "PAIRS", 50)
    monkeypatch.setattr(neighbours, "CONTRIBUTIONS", 40)
    pairs = random_pairs(7)
    for entries in (100, 1):
        monkeypatch.setattr(in_tasks, "SHUFFLED", entries)
        similar = neighbours.similar_items(as_ix(spark, pairs), 5)
        assert "MapInArrow" not in operators(similar)
        assert rows(similar) == brute_similar(pairs, 5)
        near = spark.createDataFrame(similar.collect(), similar.schema)
        lists = neighbours.personalised_knn(as_ix(spark, pairs), near, 4)
        assert "MapInArrow" not in operators(lists)
        assert rows(lists) == brute_personal(pairs, rows(near), 4)


def test_codes_beyond_the_table(spark, monkeypatch):
    monkeypatch.setattr(in_tasks, "TABLE", 3)
    sizes = in_tasks.Sizes(9)
    sizes.add(in_tasks.np.array([9, 2, 9], in_tasks.np.int32), in_tasks.np.array([4, 7, 4], in_tasks.np.int16))
    assert sizes.of(in_tasks.np.array([2, 9])).tolist() == [7.0, 4.0]


@pytest.mark.parametrize("wide", [1, 1 << 50])
def test_best_places(wide):
    """Scores that fit into one number with group and place, and scores that do not."""
    np = in_tasks.np
    group, score = np.array([0, 0, 0, 3, 3]), np.array([1, 5, 5, 2, 9]) * wide
    order, rank = in_tasks.best_places(group, score, 2)
    assert order.tolist() == [1, 2, 4, 3] and rank.tolist() == [1, 2, 1, 2]
