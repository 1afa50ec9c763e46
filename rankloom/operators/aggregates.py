"""Counters, duplicates, nesting, fingerprints and rule reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.session import materialise


def metric_counters(points: DataFrame, period: str = "1 day") -> DataFrame:
    """Summed counter values per period, service and name: from TS, service,
    name, value to period_start, service, name, total."""
    return (
        points.groupBy(F.window("TS", period).alias("period"), "service", "name")
        .agg(F.sum("value").alias("total"))
        .select(F.col("period.start").alias("period_start"), "service", "name", "total")
    )


def duplicate_keys(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("occurrences")).where(F.col("occurrences") > 1)


def nest_children(df: DataFrame, parent: str, columns: list[str], part_size: int = 1000) -> DataFrame:
    """Children of each parent as sorted lists: parent, part, first, children.

    Children are numbered from 0 by ``columns[0]``, which must tell those of one
    parent apart, and every ``part_size`` of them are one part; ``first`` is the
    number of a part's first child. The form is the same for every size.

    The numbering needs no task to see a whole parent: rows are spread by range,
    numbered within their range, and raised by the counts of earlier ranges.
    """
    by_range = df.select(parent, *columns).repartitionByRange(parent, columns[0])
    placed = materialise(by_range.withColumn("_range", F.spark_partition_id()), "ranges")
    counts = materialise(placed.groupBy(parent, "_range").agg(F.count(F.lit(1)).alias("_rows")), "range-counts")
    earlier = Window.partitionBy(parent).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(parent, "_range", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy(parent, "_range").orderBy(columns[0])
    numbered = placed.withColumn("_nth", F.row_number().over(within) - 1).join(before, [parent, "_range"])
    part = F.floor((F.col("_before") + F.col("_nth")) / F.lit(part_size)).cast("long")
    return (
        numbered.withColumn("part", part)
        .groupBy(parent, "part")
        .agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("children"))
        .select(parent, "part", (F.col("part") * part_size).alias("first"), "children")
    )


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Row count and checksum of the content, whatever the row order.

    A check value to see whether data changed, not a cryptographic digest: the
    sum over all rows of 60 bits of a digest. Nulls are marked and every value
    has its length before it, so nothing can move between columns unseen. The
    sum is kept in a wide decimal, as billions of rows overflow a long.
    """
    values = [F.col(c).cast("string") for c in columns]
    text = F.concat(*[F.when(v.isNull(), "n").otherwise(F.concat(F.length(v).cast("string"), F.lit(":"), v)) for v in values])
    head = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(28,0)")
    checksum = F.coalesce(F.sum(head), F.lit(0)) % F.lit(1 << 62).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("row_count"), checksum.cast("long").alias("checksum"))


def attribution_report(ix: DataFrame) -> DataFrame:
    """Count and summed value of interactions per day and event type."""
    return ix.groupBy(F.to_date("TS").alias("day"), "EVENT_TYPE").agg(
        F.count(F.lit(1)).alias("interactions"), F.sum("EVENT_VALUE").alias("total_value")
    )


def distinct_names(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def dataset_rules(
    tables: dict[str, DataFrame], rules: list[tuple[str, str, Column]], required: tuple[str, ...] = ("interactions",)
) -> DataFrame:
    """Failures per rule, all rules reported: table, rule, failures.

    ``rules`` holds (table, rule, condition of a failing row). Each table is
    read once however many rules it has. A required table fails if it is empty.
    """
    reports = []
    for name, df in tables.items():
        checks = [
            F.sum(F.when(failing, 1).otherwise(0)).alias(rule) for table, rule, failing in rules if table == name
        ]
        if name in required:
            checks.append(F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).alias("not_empty"))
        if not checks:
            continue
        wide = df.agg(*checks)
        filled = wide.select([F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in wide.columns])
        long = filled.unpivot([], filled.columns, "rule", "failures")
        reports.append(long.select(F.lit(name).alias("table"), "rule", "failures"))
    return reduce(DataFrame.unionByName, reports)


def well_formed_tags(tags: str) -> Column:
    """Every entry of a JSON list has exactly the keys tagKey and tagValue."""
    entries = F.from_json(F.col(tags), "array<string>")
    exact = F.forall(entries, lambda e: F.array_sort(F.json_object_keys(e)) == F.array(F.lit("tagKey"), F.lit("tagValue")))
    return F.coalesce(exact, F.lit(False))
