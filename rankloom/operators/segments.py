"""User segments: who is closest to an item or to an attribute value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.numeric import round6
from rankloom.operators.in_tasks import CONTRIBUTIONS, best_sums, fits_int, tasks_for, whole_millionths
from rankloom.operators.indexes import dense_index
from rankloom.operators.neighbours import affinity, compact_scores
from rankloom.operators.ranking import topk
from rankloom.session import materialise


#: Users of one item that go into one row, and contributions to one item that one task may add up.
LIST, HOT = 1000, 1_000_000


def item_segments(ix: DataFrame, similar: DataFrame, input_items: DataFrame, k: int = 25) -> DataFrame:
    """For each input item, users by raw affinity: ITEM_ID, USER_ID, score, rank.

    An input item is sent the users of its neighbours in lists and sums inside its task. Items
    with more than ``HOT`` contributions are spread by (user, item) instead.
    """
    wanted = input_items.select(F.col("ITEM_ID").alias("SIMILAR_ID"))
    near = similar.join(wanted, "SIMILAR_ID", "left_semi").select("ITEM_ID", "SIMILAR_ID", "score")
    near = materialise(near, "near-wanted")
    seen = materialise(ix.select("USER_ID", "ITEM_ID").distinct(), "seen")
    held = materialise(seen.groupBy("ITEM_ID").agg(F.count(F.lit(1)).alias("n")), "item-users")
    reach = materialise(near.join(held, "ITEM_ID").groupBy("SIMILAR_ID").agg(F.sum("n").alias("n")), "reach")
    size = reach.agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    score = compact_scores(near)

    kinds = [seen.schema["USER_ID"].dataType, near.schema["SIMILAR_ID"].dataType]
    sent = "int" if fits_int(seen, "USER_ID") else kinds[0].simpleString()
    user = F.struct(F.col("USER_ID").cast(sent).alias("USER_ID"))
    part = F.pmod(F.xxhash64("USER_ID"), F.ceil(F.col("n") / LIST)).alias("part")
    lists = seen.join(held, "ITEM_ID").groupBy("ITEM_ID", part).agg(F.collect_list(user).alias("users"))
    hot = reach.where(F.col("n") > HOT).select(F.col("SIMILAR_ID").alias("ITEM_ID"))
    some_hot = (size.most or 0) > HOT
    light = near.join(hot.withColumnRenamed("ITEM_ID", "SIMILAR_ID"), "SIMILAR_ID", "left_anti") if some_hot else near
    rows = light.join(lists, "ITEM_ID").select(
        F.col("SIMILAR_ID").alias("ITEM_ID"), F.col("users.USER_ID").alias("USER_ID"), score.alias("score")
    )
    tasks = tasks_for(ix.sparkSession, float(size["all"] or 0), CONTRIBUTIONS)
    best = best_sums(rows.repartition(tasks, "ITEM_ID"), "ITEM_ID", "USER_ID", k, (kinds[1].simpleString(), sent))
    best = best.withColumn("USER_ID", F.col("USER_ID").cast(kinds[0]))
    if some_hot:
        spread = topk(affinity(ix, similar, items=hot), k, by=["ITEM_ID"], id="USER_ID")
        best = best.unionByName(spread.select("ITEM_ID", "USER_ID", "score", "rank"))
    return best


def attribute_segments(
    ix: DataFrame,
    similar: DataFrame,
    items: DataFrame,
    attribute: str,
    values: DataFrame,
    k: int = 25,
    heavy_user_items: int = 2000,
) -> DataFrame:
    """For each input value of ``attribute``, users by summed affinity to the
    items holding it: attribute, USER_ID, score, rank.

    A user is sent the summed neighbours of each of its items as one list of (value, score). The task
    adds them up for its users and keeps the best ``k`` of each value; these meet at the end.
    Users with more than ``heavy_user_items`` items are spread by (user, value) instead.
    """
    values = materialise(dense_index(values.join(items, attribute, "left_semi"), attribute, "value-order"), "value-codes")
    unit = 1e6 if whole_millionths(similar) else 1.0
    score = F.round(F.col("score") * 1e6).cast("long") if unit > 1 else F.col("score").cast("double")
    reach = _reach(similar.withColumn("score", score), items.join(values, attribute).drop(attribute), "index")
    reach = materialise(reach, "reach")
    if unit > 1 and fits_int(reach, "score"):
        reach = reach.withColumn("score", F.col("score").cast("int"))

    seen = materialise(ix.select("USER_ID", "ITEM_ID").distinct(), "seen")
    held = materialise(seen.groupBy("USER_ID").agg(F.count(F.lit(1)).alias("held")), "user-items")
    size = held.agg(F.max("held").alias("most"), F.sum("held").alias("all")).first()
    heavy_users = held.where(F.col("held") > heavy_user_items).select("USER_ID")
    some_heavy = (size.most or 0) > heavy_user_items
    light = seen.join(heavy_users, "USER_ID", "left_anti") if some_heavy else seen
    lists = reach.groupBy("ITEM_ID").agg(F.collect_list(F.struct("index", "score")).alias("reach"))
    lists = materialise(lists, "reach-lists")
    widest = lists.agg(F.max(F.size("reach")).alias("widest")).first().widest or 1
    kind = seen.schema["USER_ID"].dataType
    sent = "int" if fits_int(seen, "USER_ID") else kind.simpleString()
    rows = light.join(lists, "ITEM_ID").select(
        F.col("USER_ID").cast(sent).alias("USER_ID"), F.col("reach.index").alias("index"), F.col("reach.score").alias("score")
    )
    tasks = tasks_for(ix.sparkSession, float(size["all"] or 0) * widest, CONTRIBUTIONS)
    best = best_sums(rows.repartition(tasks, "USER_ID"), "index", "USER_ID", k, ("int", sent)).drop("rank")
    if some_heavy:
        heavy = seen.join(heavy_users, "USER_ID", "left_semi").join(reach, "ITEM_ID")
        summed = heavy.groupBy("index", "USER_ID").agg(round6(F.sum("score") / unit).alias("score"))
        best = best.withColumn("USER_ID", F.col("USER_ID").cast(kind)).unionByName(summed)
    best = best.withColumn("USER_ID", F.col("USER_ID").cast(kind)).join(values, "index")
    return topk(best, k, by=[attribute], id="USER_ID").select(attribute, "USER_ID", "score", "rank")


def _reach(similar: DataFrame, held: DataFrame, value: str) -> DataFrame:
    """Summed scores of the neighbours of an item that hold a value: ITEM_ID, value, score."""
    held = held.select(F.col("ITEM_ID").alias("SIMILAR_ID"), value)
    return similar.join(held, "SIMILAR_ID").groupBy("ITEM_ID", value).agg(F.sum("score").alias("score"))


def attribute_scores(
    ix: DataFrame, similar: DataFrame, items: DataFrame, attribute: str, values: DataFrame
) -> DataFrame:
    """Summed affinity of users to the items holding a value: attribute, USER_ID, score.

    Affinity is a sum over neighbours, so neighbours are summed per (item,
    value) first. That table is no larger than the neighbour table and usually
    far smaller, and the history then joins it with one row per value instead
    of one per neighbour.
    """
    held = items.join(values.select(attribute), attribute, "left_semi")
    reach = _reach(similar, held, attribute)
    seen = ix.select("USER_ID", "ITEM_ID").distinct()
    return seen.join(reach, "ITEM_ID").groupBy(attribute, "USER_ID").agg(round6(F.sum("score")).alias("score"))
