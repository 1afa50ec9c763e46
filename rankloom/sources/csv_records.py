"""Records of CSV files whose quoted fields may hold line breaks.

Files are read as lines, in splits. What a line does to the state "inside quotes"
is a function of two values: most lines change nothing, some flip the state, some
set it. Such functions compose, so the lines of a split are composed first, then
the splits of a file (one row each), and every line knows its state without the
file passing through one place. Only lines with quotes that change the state take
part, and only lines inside of quotes are joined to the line where they opened.

A quote opens a field at its start only, and doubled quotes are text, as RFC 4180
has it. A quote that is never closed joins nothing: its lines stay lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.session import materialise


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, part (where the split begins), place (ascending within a split)."""
    lines = spark.read.option("pathGlobFilter", "*.csv").option("lineSep", "\n").text(path)
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("part"),
        F.monotonically_increasing_id().alias("place"),
    )


def _ends_inside(start: bool) -> Column:
    """Whether a line that starts inside quotes, or outside, ends inside."""
    texts = F.split(F.replace("value", F.lit('""'), F.lit("")), '"', -1)

    def quote(state: Column, text: Column) -> Column:
        # A quote stands between two texts; the first text has none before it.
        first_field = (state["n"] == 1) & (state["before"] == "")
        opens = first_field | F.endswith(state["before"], F.lit(","))
        inside = F.when(state["n"] == 0, state["inside"]).otherwise(~state["inside"] & opens)
        return F.struct(inside.alias("inside"), text.alias("before"), (state["n"] + 1).alias("n"))

    begin = F.struct(F.lit(start).alias("inside"), F.lit("").alias("before"), F.lit(0).alias("n"))
    return F.aggregate(texts, begin, quote)["inside"]


def _state(window, start: Column) -> Column:
    """The state after the functions (sets, value, flips) in the window, from ``start``."""
    set_to = F.last(F.when(F.col("sets"), F.struct("value", "so_far")), ignorenulls=True).over(window)
    flips = F.coalesce(F.sum("flips").over(window), F.lit(0))
    odd = (flips - F.coalesce(set_to["so_far"], F.lit(0))) % 2 == 1
    return F.coalesce(set_to["value"], start) != odd


def _changing(lines: DataFrame) -> DataFrame:
    """The lines that change the state: out and into say where they lead from outside and inside."""
    some = lines.where(F.contains("value", F.lit('"')))
    return some.select("file", "part", "place", _ends_inside(False).alias("out"), _ends_inside(True).alias("into")).where("out OR NOT into")


def _as_functions(rows: DataFrame, over: list[str], order: str) -> DataFrame:
    so_far = Window.partitionBy(*over).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flips = (F.col("out") & ~F.col("into")).cast("int")
    return rows.withColumns({"sets": F.col("out") == F.col("into"), "value": F.col("out"), "flips": flips}).withColumn(
        "so_far", F.sum("flips").over(so_far)
    )


def _continued(lines: DataFrame) -> DataFrame:
    """place, owner for every line inside of quotes: the line that opened them."""
    by_split, by_file = ["file", "part"], ["file"]
    earlier, to_here = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, Window.currentRow)
    in_split, in_file = Window.partitionBy(*by_split).orderBy("place"), Window.partitionBy(*by_file).orderBy("part")
    rows = materialise(_as_functions(_changing(lines), by_split, "place"), "csv-quotes")
    # What a whole split does, from outside and from inside; splits without such lines do nothing.
    whole = in_split.rowsBetween(*to_here)
    ends = rows.select(*by_split, "place", _state(whole, F.lit(False)).alias("out"), _state(whole, F.lit(True)).alias("into"))
    ends = ends.groupBy(*by_split).agg(F.max_by("out", "place").alias("out"), F.max_by("into", "place").alias("into"), F.min("place").alias("changed"))
    splits = lines.groupBy(*by_split).agg(F.min("place").alias("first"), F.max("place").alias("last")).join(ends, by_split, "left")
    splits = _as_functions(splits.fillna({"out": False, "into": True}), by_file, "part")
    splits = splits.select(
        *by_split, "first", "last", "changed",
        _state(in_file.rowsBetween(*earlier), F.lit(False)).alias("starts"), _state(in_file.rowsBetween(*to_here), F.lit(False)).alias("ends"),
    )
    splits = materialise(splits, "csv-splits")
    rows = rows.join(splits.select(*by_split, "starts", "last"), by_split)
    rows = rows.withColumn("before", _state(in_split.rowsBetween(*earlier), F.col("starts"))).withColumn(
        "after", _state(whole, F.col("starts"))
    )
    opens = F.when(~F.col("before") & F.col("after"), F.col("place"))
    rows = materialise(rows.withColumn("opened", F.last(opens, ignorenulls=True).over(whole)).withColumn("next", F.lead("place").over(in_split)), "csv-states")
    opened = rows.groupBy(*by_split).agg(F.max_by("opened", "place").alias("opened"))
    splits = splits.join(opened, by_split, "left").withColumns({
        "carried": F.last("opened", ignorenulls=True).over(in_file.rowsBetween(*earlier)),
        "newest": F.last("opened", ignorenulls=True).over(in_file.rowsBetween(*to_here)),
    })
    splits = materialise(splits, "csv-openers")
    never_closed = splits.groupBy("file").agg(F.max_by(F.struct("ends", "newest"), "part").alias("last")).where("last.ends").select(
        F.col("last.newest").alias("owner")
    )
    carried = splits.select(*by_split, "carried")
    within = rows.where("after").join(carried, by_split).select(
        F.coalesce("opened", "carried").alias("owner"), (F.col("place") + 1).alias("from"), F.coalesce("next", "last").alias("to")
    )
    across = splits.where("starts").select(F.col("carried").alias("owner"), F.col("first").alias("from"), F.coalesce("changed", "last").alias("to"))
    ranges = within.unionByName(across).where(F.col("from") <= F.col("to")).join(never_closed, "owner", "left_anti")
    return ranges.select("owner", F.explode(F.sequence("from", "to")).alias("place")).distinct()


def records(spark: SparkSession, path: str) -> DataFrame:
    """value, file, part, place for every record; a record stands where its first line does."""
    lines = read_lines(spark, path)
    multiple = materialise(_changing(lines).where("out").select("file").distinct(), "csv-multiline")
    if not multiple.isEmpty():
        # Written once, so that every later stage sees the same places.
        some = materialise(lines.join(multiple, "file", "left_semi"), "csv-lines")
        continued = materialise(_continued(some), "csv-continued")
        held = continued.unionByName(continued.select("owner", F.col("owner").alias("place")).distinct())
        held = materialise(some.join(held, "place", "left").select("value", "file", "part", "place", "owner"), "csv-owned")
        texts = F.transform(F.sort_array(F.collect_list(F.struct("part", "place", "value"))), lambda line: line["value"])
        first = F.min(F.struct("part", "place"))
        joined = held.where("owner IS NOT NULL").groupBy("file", "owner").agg(F.array_join(texts, "\n").alias("value"), first.alias("first"))
        joined = joined.select("value", "file", F.col("first.part").alias("part"), F.col("first.place").alias("place"))
        plain = lines.join(multiple, "file", "left_anti")
        lines = plain.unionByName(held.where("owner IS NULL").drop("owner")).unionByName(joined)
    return lines.withColumn("value", F.when(F.endswith("value", F.lit("\r")), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value")))
