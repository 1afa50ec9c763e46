"""Similar items by co-occurrence, and personal lists built on them.

Similarity is the cosine on distinct (user, item) pairs,
``c_ij / sqrt(n_i n_j)`` with c_ij the users who chose both items (item-based
collaborative filtering, Sarwar et al. 2001), rounded to six places.

Counting c_ij means pairing the items of each user, which is quadratic in the
items of one user. Users are therefore split by their number of items:

* light users (``heavy_user_items`` or fewer items): their baskets go to the blocks
  of items they touch and are paired inside the tasks (``in_tasks``). Each basket is
  bounded, so work grows linearly with the data, and no pair is shuffled.
* heavy users: items chosen by the *same set* of heavy users are alike for
  every heavy count, so they are collapsed into one profile before pairing.
  One user holding a third of all rows collapses into a single profile and
  adds one pair instead of the square of its items. Profile pairs are counted
  in blocks, so no task ever holds more than one block pair of one user.

The parts are added up; nobody is dropped, capped or sampled. Profiles are told
apart by size and two 64-bit hashes, so only a collision in all three could
merge two of them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.numeric import round6
from rankloom.operators.in_tasks import (
    CONTRIBUTIONS,
    best_neighbours,
    best_sums,
    fits_int,
    in_rounds,
    rounds_for,
    tasks_for,
    whole_millionths,
)
from rankloom.operators.ranking import topk, topk_global
from rankloom.session import materialise

PAIRS_PER_TASK = 20_000_000


def cosine(c, n_a, n_b):
    return round6(F.col(c) / F.sqrt(F.col(n_a).cast("double") * F.col(n_b).cast("double")))


def similar_items(ix: DataFrame, k: int = 25, heavy_user_items: int = 2000) -> DataFrame:
    """Best ``k`` neighbours of each item: ITEM_ID, SIMILAR_ID, score, rank.

    ``heavy_user_items`` only moves work between the two ways of counting. Users
    above it are compared by profiles, which are told apart by size and two
    64-bit hashes: the result is the same unless profiles collide in all three.
    """
    chosen = materialise(ix.select("USER_ID", "ITEM_ID").distinct(), "chosen")
    held = chosen.groupBy("USER_ID").agg(F.count(F.lit(1)).alias("held"))
    is_light = F.col("held") <= heavy_user_items
    size = held.agg(
        F.max("held").alias("most"),
        F.sum(F.when(is_light, F.col("held").cast("double") * F.col("held"))).alias("light_pairs"),
    ).first()
    pairs = size.light_pairs or 0.0
    seen = materialise(_with_item_counts(chosen), "seen")
    if (size.most or 0) <= heavy_user_items:
        return best_neighbours(seen, pairs, k)

    heavy_users = materialise(held.where(~is_light).select("USER_ID"), "heavy-users")
    light = seen.join(heavy_users, "USER_ID", "left_anti")
    heavy = materialise(seen.join(heavy_users, "USER_ID", "left_semi"), "heavy")
    profiles = materialise(_profiles(heavy), "profiles")
    overlap = materialise(_profile_overlap(heavy, profiles, max(heavy_user_items, 1)), "overlap")

    profile_a = profiles.select(F.col("ITEM_ID").alias("a"), F.col("profile").alias("pa"))
    profile_b = profiles.select(F.col("ITEM_ID").alias("b"), F.col("profile").alias("pb"))
    # Light users alone rank a pair exactly unless heavy users hold both of its items;
    # only such pairs are counted one by one.
    by_light = best_neighbours(light, pairs, k).select("ITEM_ID", "SIMILAR_ID", "score")
    of_both = light.join(profiles.select("ITEM_ID"), "ITEM_ID", "left_semi")
    with_light = (
        _pair_counts(of_both, _tasks_for(chosen, pairs / 2))
        .join(profile_a, "a", "left")
        .join(profile_b, "b", "left")
        .join(overlap, ["pa", "pb"], "left")
        .withColumn("c", F.col("c") + F.coalesce("shared", F.lit(0)))
        .withColumn("score", cosine("c", "n_a", "n_b"))
    )
    # A pair in several parts has its full score in the first and a part of it in
    # the others, so the largest one is the true one.
    both = _mirrored(with_light.select("a", "b", "score")).unionByName(_heavy_candidates(profiles, overlap, k))
    both = both.unionByName(by_light)
    return _ranked(both.groupBy("ITEM_ID", "SIMILAR_ID").agg(F.max("score").alias("score")), k)


def _with_item_counts(chosen: DataFrame) -> DataFrame:
    """(user, item) rows with the item's number of users.

    Joining the count here, on rows, saves joining it twice on pairs. The
    counts are written first: as a plain table they are broadcast if small, and
    otherwise leave AQE free to split an item that a third of the rows hold.
    """
    counts = materialise(chosen.groupBy("ITEM_ID").agg(F.count(F.lit(1)).alias("n")), "item-counts")
    return chosen.join(counts, "ITEM_ID")


def _tasks_for(seen: DataFrame, pairs: float) -> int:
    """Shuffle width for the pairing: its output, not its input, is what is big."""
    configured = int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(configured, math.ceil(pairs / PAIRS_PER_TASK))


def _pair_counts(seen: DataFrame, tasks: int) -> DataFrame:
    """Users per item pair a < b. Pairs are summed map-side as they are made.

    Both sides of the self-join read one shuffle. The counts ``n`` depend on
    the items alone, so they ride along as grouping columns.
    """
    by_user = seen.repartition(tasks, "USER_ID")
    left = by_user.select("USER_ID", F.col("ITEM_ID").alias("a"), F.col("n").alias("n_a"))
    right = by_user.select("USER_ID", F.col("ITEM_ID").alias("b"), F.col("n").alias("n_b"))
    pairs = left.hint("merge").join(right, "USER_ID").where(F.col("a") < F.col("b"))
    return pairs.groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("c"))


def _mirrored(pairs: DataFrame) -> DataFrame:
    """Each pair seen from both items, without computing the pairs twice."""
    ends = F.array(
        F.struct(F.col("a").alias("ITEM_ID"), F.col("b").alias("SIMILAR_ID")),
        F.struct(F.col("b").alias("ITEM_ID"), F.col("a").alias("SIMILAR_ID")),
    )
    return pairs.select(F.explode(ends).alias("end"), "score").select("end.ITEM_ID", "end.SIMILAR_ID", "score")


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    return topk(scored, k, by=["ITEM_ID"], id="SIMILAR_ID").select("ITEM_ID", "SIMILAR_ID", "score", "rank")


def _profiles(heavy: DataFrame) -> DataFrame:
    """ITEM_ID, n, profile: equal profiles mean equal sets of heavy users.

    The set is summed up by its size and two order-free 64-bit hashes, so a
    hot item never has its users collected into one row.
    """
    def mixed(seed: int):
        return F.bit_xor(F.xxhash64(F.lit(seed), F.col("USER_ID"))).cast("string")

    return heavy.groupBy("ITEM_ID").agg(
        F.max("n").alias("n"),
        F.concat_ws(":", F.count(F.lit(1)).cast("string"), mixed(1), mixed(2)).alias("profile"),
    )


def _profile_overlap(heavy: DataFrame, profiles: DataFrame, block: int) -> DataFrame:
    """Heavy users shared by each ordered pair of profiles: pa, pb, shared.

    One item stands for its profile. The profiles of one user are dealt into
    blocks of about ``block``; a row meets each block pair it belongs to, so
    even a user with a huge number of profiles is spread over many tasks.
    """
    stand_in = profiles.groupBy("profile").agg(F.min("ITEM_ID").alias("ITEM_ID"))
    members = heavy.select("USER_ID", "ITEM_ID").join(stand_in, "ITEM_ID").select("USER_ID", "profile")
    members = materialise(members, "members")
    held = members.groupBy("USER_ID").agg(F.count(F.lit(1)).alias("held"))
    blocks = materialise(held.select("USER_ID", F.ceil(F.col("held") / F.lit(block)).cast("int").alias("blocks")), "blocks")
    dealt = members.join(blocks, "USER_ID").withColumn("own", F.pmod(F.hash("profile"), F.col("blocks")))

    lower = dealt.select(
        "USER_ID",
        F.col("profile").alias("pa"),
        F.col("own").alias("row"),
        F.explode(F.sequence(F.col("own"), F.col("blocks") - 1)).alias("col"),
    )
    upper = dealt.select(
        "USER_ID",
        F.col("profile").alias("pb"),
        F.explode(F.sequence(F.lit(0), F.col("own"))).alias("row"),
        F.col("own").alias("col"),
    )
    # Within one block only pa <= pb; across two blocks every pair is new.
    pairs = lower.join(upper, ["USER_ID", "row", "col"]).where(
        (F.col("row") < F.col("col")) | (F.col("pa") <= F.col("pb"))
    )
    counted = pairs.groupBy(
        F.least("pa", "pb").alias("pa"), F.greatest("pa", "pb").alias("pb")
    ).agg(F.count(F.lit(1)).alias("shared"))
    both_ways = F.when(
        F.col("pa") == F.col("pb"), F.array(F.struct("pa", "pb"))
    ).otherwise(
        F.array(F.struct("pa", "pb"), F.struct(F.col("pb").alias("pa"), F.col("pa").alias("pb")))
    )
    return counted.select(F.explode(both_ways).alias("end"), "shared").select("end.pa", "end.pb", "shared")


def _heavy_candidates(profiles: DataFrame, overlap: DataFrame, k: int) -> DataFrame:
    """Best neighbours of each item by its heavy users alone.

    Items of one class (same profile, same n) score alike against any other
    item, so the smallest k + 1 ids stand for the class (one more than k, as an
    item may meet itself), and the list is made once per class.
    """
    shortlist = topk(
        profiles.withColumn("score", F.lit(0)), k + 1, by=["profile", "n"]
    ).select(F.col("profile").alias("pb"), F.col("n").alias("n_b"), F.col("ITEM_ID").alias("SIMILAR_ID"))
    classes = profiles.select(F.col("profile").alias("pa"), F.col("n").alias("n_a")).distinct()
    class_pairs = classes.join(overlap, "pa").join(shortlist, "pb")
    scored = class_pairs.withColumn("score", cosine("shared", "n_a", "n_b"))
    class_lists = topk(scored, k + 1, by=["pa", "n_a"], id="SIMILAR_ID").select("pa", "n_a", "SIMILAR_ID", "score")
    class_lists = materialise(class_lists, "class-lists")
    members = profiles.select("ITEM_ID", F.col("profile").alias("pa"), F.col("n").alias("n_a"))
    return (
        members.join(class_lists, ["pa", "n_a"])
        .where(F.col("ITEM_ID") != F.col("SIMILAR_ID"))
        .select("ITEM_ID", "SIMILAR_ID", "score")
    )


def chosen_items(ix: DataFrame) -> DataFrame:
    """Distinct (user, item) with the number of interactions: all that the
    personal recipes need to know of ``ix``, in one pass over it."""
    return ix.groupBy("USER_ID", "ITEM_ID").agg(F.count(F.lit(1)).alias("times"))


def _contributions(chosen: DataFrame, similar: DataFrame) -> DataFrame:
    """One row per (user's item, neighbour): USER_ID, ITEM_ID, score.

    The join has a bounded fan-out (k neighbours per item) and two plain
    shuffles under it, so AQE may split a hot item or broadcast a small table.
    """
    held = chosen.select("USER_ID", F.col("ITEM_ID").alias("FROM_ID"))
    near = similar.select(F.col("ITEM_ID").alias("FROM_ID"), F.col("SIMILAR_ID").alias("ITEM_ID"), "score")
    return held.join(near, "FROM_ID").select("USER_ID", "ITEM_ID", "score")


def affinity(
    ix: DataFrame, similar: DataFrame, users: DataFrame | None = None, items: DataFrame | None = None
) -> DataFrame:
    """Raw scores: summed similarity from a user's items to every neighbour,
    items already seen included. USER_ID, ITEM_ID, score.

    ``users`` and ``items`` restrict the scores to the given ids. They cut the
    history and the neighbour table before these meet, so the work follows the
    lists; Catalyst would push such a semi-join below the sum only for a list
    small enough to broadcast.
    """
    chosen = chosen_items(ix if users is None else ix.join(users.select("USER_ID"), "USER_ID", "left_semi"))
    if items is not None:
        wanted = items.select(F.col("ITEM_ID").alias("SIMILAR_ID"))
        similar = similar.join(wanted, "SIMILAR_ID", "left_semi")
    added = _contributions(chosen, similar)
    return added.groupBy("USER_ID", "ITEM_ID").agg(round6(F.sum("score")).alias("score"))


def personalised_knn(
    ix: DataFrame, similar: DataFrame, k: int = 25, users: DataFrame | None = None, heavy_user_items: int = 2000
) -> DataFrame:
    """Top ``k`` unseen items of each user: USER_ID, ITEM_ID, score, rank.

    ``users`` adds everyone without interactions; they get the popular items.
    The scores of a light user are bounded, so the neighbour lists of its items are
    shuffled by user and summed and ranked there. Those of a heavy user are spread by
    (user, item) and cut to k rows per task before they meet.
    """
    chosen = materialise(chosen_items(ix), "chosen")
    held = chosen.groupBy("USER_ID").agg(F.count(F.lit(1)).alias("held"))
    most = held.agg(F.max("held").alias("most")).first().most or 0
    if most <= heavy_user_items:
        lists = _best_of_light(chosen, similar, k)
    else:
        heavy_users = materialise(held.where(F.col("held") > heavy_user_items).select("USER_ID"), "heavy-users")
        light = chosen.join(heavy_users, "USER_ID", "left_anti")
        heavy = chosen.join(heavy_users, "USER_ID", "left_semi")
        lists = _best_of_light(light, similar, k).unionByName(_best_unseen(heavy, similar, k))
    if users is None:
        return lists
    return lists.unionByName(popular_for(cold_users(users, chosen), chosen, k))


def compact_scores(similar: DataFrame):
    """The scores as integer millionths where that loses nothing."""
    score = F.col("score")
    return F.round(score * 1e6).cast("int") if whole_millionths(similar) else score.cast("double")


def _best_of_light(chosen: DataFrame, similar: DataFrame, k: int) -> DataFrame:
    kinds = [df.schema[c].dataType for df, c in ((chosen, "USER_ID"), (similar, "SIMILAR_ID"))]
    small = fits_int(similar, "SIMILAR_ID") and fits_int(chosen, "ITEM_ID")
    sent = "int" if small else kinds[1].simpleString()
    entry = F.struct(F.col("SIMILAR_ID").cast(sent).alias("id"), compact_scores(similar).alias("score"))
    near = similar.groupBy(F.col("ITEM_ID").alias("FROM_ID")).agg(F.collect_list(entry).alias("near"))
    near = materialise(near, "near-lists")
    widest = near.agg(F.max(F.size("near")).alias("widest")).first().widest or 1
    entries = float(chosen.count()) * widest
    tasks, rounds = tasks_for(chosen.sparkSession, entries, CONTRIBUTIONS), rounds_for(entries)

    def some(turn: int) -> DataFrame:
        mine = chosen.where(F.pmod(F.xxhash64("USER_ID"), F.lit(rounds)) == turn) if rounds > 1 else chosen
        rows = mine.join(near, mine["ITEM_ID"] == near["FROM_ID"], "left").select(
            "USER_ID", F.col("ITEM_ID").cast(sent).alias("own"), F.col("near.id").alias("ITEM_ID"), F.col("near.score").alias("score")
        )
        dealt = rows.repartition(-(-tasks // rounds), "USER_ID")
        return best_sums(dealt, "USER_ID", "ITEM_ID", k, (kinds[0].simpleString(), sent), "own")

    best = in_rounds(some, rounds, "lists-part")
    return best.withColumn("ITEM_ID", F.col("ITEM_ID").cast(kinds[1]))


def _best_unseen(chosen: DataFrame, similar: DataFrame, k: int) -> DataFrame:
    """Seen items go through the same aggregate as marked rows and are dropped
    after it, which saves the shuffle and the sorts of an anti-join."""
    added = _contributions(chosen, similar).select("USER_ID", "ITEM_ID", "score", F.lit(0).alias("seen"))
    marks = chosen.select("USER_ID", "ITEM_ID", F.lit(0.0).alias("score"), F.lit(1).alias("seen"))
    fresh = (
        added.unionByName(marks)
        .groupBy("USER_ID", "ITEM_ID")
        .agg(round6(F.sum("score")).alias("score"), F.max("seen").alias("seen"))
        .where(F.col("seen") == 0)
        .drop("seen")
    )
    return topk(fresh, k, by=["USER_ID"]).select("USER_ID", "ITEM_ID", "score", "rank")


def cold_users(users: DataFrame, chosen: DataFrame) -> DataFrame:
    known = chosen.select("USER_ID").distinct()
    return users.select("USER_ID").distinct().join(known, "USER_ID", "left_anti")


def popular_for(users: DataFrame, chosen: DataFrame, k: int) -> DataFrame:
    """The ``k`` popular items for each given user.

    The list is a scalar subquery: one value of k entries, computed once and
    unfolded per user, so no join is needed.
    """
    counts = chosen.groupBy("ITEM_ID").agg(F.sum("times").alias("score"))
    best_first = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "ITEM_ID")))
    top = topk_global(counts, k).agg(best_first.alias("top")).scalar()
    unfolded = users.select("USER_ID", F.posexplode(top).alias("place", "entry"))
    return unfolded.select(
        "USER_ID",
        F.col("entry.ITEM_ID").alias("ITEM_ID"),
        (-F.col("entry.neg")).cast("double").alias("score"),
        (F.col("place") + 1).cast("long").alias("rank"),
    )
