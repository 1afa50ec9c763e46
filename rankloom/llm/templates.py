"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

A text becomes a row of tokens in which numbers, names and units carry a mark and
their value. The template is the same row without the values, so a question with
other numbers or names has the same template. Windows of ``window`` template
tokens of the benchmark meet those of the documents in a hash join. Where they
meet, the values have to agree: along one alignment of document and item each
value of the item must stand for one value of the document. Windows where it stands
for another one than in most of its places are left out, and so are windows in which
two values became one; the others of the alignment count. Windows with equal words
count also where a value clashes, if it is the only one. An item is found in a
document if the counted windows make up at least ``min_share`` of its windows, or if
``min_run`` of its tokens stand there literally in a row, whatever their share.

A name is told by a capital inside a sentence, so a copy that stands elsewhere in its
sentence can have other marks. The same windows of the plain lower-case tokens meet
in the same join, which finds literal copies whatever their marks.

Cases: null and empty texts have no tokens; items shorter than a window count as
one window of their own length; windows made of marks for the most part are left
out, since they meet anything; items that have no other windows, and those under
``MIN_TOKENS`` tokens, are found where all their plain tokens stand one after the
other, so an item of one word is found wherever that word stands; repeated rows give
one result per doc_id and item; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.sizes import broadcast_if_small
from rankloom.session import materialise

#: Marks of names, numbers and units, and a decimal point inside a number. Private-use characters, so no text has them by nature.
NAME, NUMBER, UNIT, POINT = "\ue000", "\ue001", "\ue002", "\ue003"
#: Items of fewer tokens have no template.
MIN_TOKENS = 4
#: Given names that are names wherever they stand, also at the start of a sentence.
NAMES = (
    "Alexander Alice Benjamin Charlotte Christopher Daniel David Deborah Dorothy Elizabeth Emily Francis Frederick "
    "George Grace Hannah Harold Henry Isabella Jacob James Jennifer Jessica John Joseph Joshua Julia Katherine Kevin "
    "Laura Lucas Margaret Maria Mary Matthew Michael Nancy Natalie Nicholas Olivia Patricia Patrick Paul Peter Rachel "
    "Rebecca Richard Robert Samuel Sarah Sophia Stephen Susan Thomas Timothy Victoria Vincent William Zachary"
).split()
#: Words that are numbers; "one" is a pronoun more often.
NUMBER_WORDS = (
    "two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|"
    "nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million"
)
UNITS = (
    "km|m|cm|mm|miles?|yards?|feet|foot|inch(?:es)?|kg|g|mg|grams?|kilograms?|tons?|pounds?|lbs?|ounces?|oz|"
    "l|ml|lit(?:er|re)s?|gallons?|cups?|seconds?|minutes?|min|hours?|hrs?|days?|weeks?|months?|years?|"
    "dollars?|cents?|euros?|usd|eur|percent|degrees?|kmh|mph|met(?:er|re)s?|kilomet(?:er|re)s?"
)


def marked(text: Column) -> Column:
    """Tokens joined by blanks; names, numbers and units with their mark before the value."""
    known = "|".join(NAMES)
    out = F.regexp_replace(text, rf"(?<=[\p{{Ll}},;:] )(?=\p{{Lu}}\p{{Ll}})|\b(?=(?:{known})\b)", NAME)
    out = F.when(F.contains(text, F.lit(NAME)), F.regexp_replace(out, rf"{NAME}+", NAME)).otherwise(out)
    out = F.lower(out)
    out = F.regexp_replace(out, r"(?<=\p{N})[.,](?=\p{N})", POINT)
    number = rf"\p{{N}}|(?:{NUMBER_WORDS})(?![\p{{L}}\p{{N}}])"
    out = F.regexp_replace(out, rf"(?<![\p{{L}}\p{{N}}{POINT}])(?={number})", NUMBER)
    out = F.regexp_replace(out, rf"[^\p{{L}}\p{{N}}\p{{M}}{NAME}-{POINT}]+", " ")
    out = F.regexp_replace(out, rf"({NUMBER}[^ ]* )(?=(?:{UNITS})(?: |$))", f"$1{UNIT}")
    return F.trim(out)


def template(marked_text: Column) -> Column:
    """The marked tokens without the values."""
    return F.regexp_replace(marked_text, rf"([{NAME}-{UNIT}])[^ ]*", "$1")


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda x: x != "")


def bare(marked_text: Column) -> Column:
    """Without the marks of names, numbers and units."""
    for mark in (NAME, NUMBER, UNIT):
        marked_text = F.replace(marked_text, F.lit(mark), F.lit(""))
    return marked_text


def plain(marked_text: Column) -> Column:
    """The tokens without marks, as many as the template has."""
    return F.when(marked_text != "", F.split(bare(marked_text), " ")).otherwise(F.array().cast("array<string>"))


def both_tokens(df: DataFrame, key: str) -> DataFrame:
    """``key`` with the tokens of its text as template (toks) and without marks (plain)."""
    text = df.select(F.col(key).cast("long").alias(key), marked(F.coalesce("text", F.lit(""))).alias("marked"))
    return text.select(key, tokens(template(F.col("marked"))).alias("toks"), plain(F.col("marked")).alias("plain"))


def with_windows(df: DataFrame, column: str, sizes: list[int]) -> DataFrame:
    """Adds ``column``_1, _2, ...: the hash of the window at every place, for each size.

    A window is two shorter ones, of a power of two each, that may share tokens: no
    token is hashed more than once. The last windows are cut short and meet no item.
    """

    def joined(half: Column, gap: int) -> Column:
        return F.transform(half, lambda h, i: F.xxhash64(h, F.get(half, i + gap)))

    df = df.withColumn(f"{column}_1", F.transform(column, lambda x: F.xxhash64(x)))
    powers = [1 << k for k in range(1, max(sizes, default=1).bit_length())]
    for size in [*powers, *sorted(set(sizes) - {1, *powers})]:
        half = 1 << ((size - 1).bit_length() - 1)
        df = df.withColumn(f"{column}_{size}", joined(F.col(f"{column}_{half}"), size - half))
    return df


def _literal_enough(window: Column, size: Column) -> Column:
    marks = F.size(F.filter(window, lambda t: t.rlike(rf"^[{NAME}-{UNIT}]")))
    return marks * 2 <= size


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, item_pos, size, n_windows, whole, counted, hash, literal) of the benchmark.

    ``whole`` items have no template; ``counted`` windows make up the share, ``literal`` ones are of plain tokens.
    """
    toks = both_tokens(benchmark, "item_id").where(F.size("toks") > 0)
    sizes = list(range(1, window + 1))
    for name in ("toks", "plain"):
        toks = with_windows(toks, name, sizes)
    of_size = {name: F.array(*[F.col(f"{name}_{k}") for k in sizes]) for name in ("toks", "plain")}
    sized = toks.withColumn("size", F.least(F.size("toks"), F.lit(window)))
    sized = sized.select(
        "item_id", "toks", "size", *[F.get(column, F.col("size") - 1).alias(f"{name}_hash") for name, column in of_size.items()]
    )
    places = sized.select(
        "*", F.explode(F.sequence(F.lit(1), F.size("toks") - F.col("size") + 1)).alias("at")
    )
    cut = places.select(
        "item_id",
        "size",
        (F.col("at") - 1).alias("item_pos"),
        F.slice("toks", F.col("at"), F.col("size")).alias("w"),
        *[F.get(f"{name}_hash", F.col("at") - 1).alias(f"{name}_hash") for name in of_size],
        (F.size("toks") >= MIN_TOKENS).alias("long_enough"),
    ).withColumn("templated", F.col("long_enough") & _literal_enough(F.col("w"), F.col("size")))
    counts = cut.groupBy("item_id").agg(
        F.countDistinct("item_pos").alias("n_all"), F.countDistinct(F.when(F.col("templated"), F.col("item_pos"))).alias("n_templated")
    ).select(
        "item_id",
        F.when(F.col("n_templated") > 0, F.col("n_templated")).otherwise(F.col("n_all")).alias("n_windows"),
        (F.col("n_templated") == 0).alias("whole"),
    )
    found_by = cut.join(counts, "item_id").withColumn("counted", F.col("templated") | F.col("whole"))
    literal = F.struct(F.col("plain_hash").alias("hash"), F.lit(True).alias("literal"))
    hashes = F.when(F.col("templated"), F.array(F.struct(F.col("toks_hash").alias("hash"), F.lit(False).alias("literal")), literal))
    rows = found_by.select(
        "item_id", "item_pos", "size", "n_windows", "whole", "counted", F.explode(hashes.otherwise(F.array(literal))).alias("name")
    ).select("*", "name.*").drop("name")
    return rows.groupBy([c for c in rows.columns if c != "literal"]).agg(F.max("literal").alias("literal"))


def _slots(rows: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """Every marked token with its place and value."""
    placed = rows.select(key, F.posexplode(tokens(marked(F.coalesce("text", F.lit(""))))).alias(pos, value))
    return placed.where(F.col(value).rlike(rf"^[{NAME}-{UNIT}]"))


def hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, doc_pos and the windows of items whose template or plain tokens meet there."""
    names = broadcast_if_small(windows)
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most `window` different ones
    toks = both_tokens(docs, "doc_id")
    for name in ("toks", "plain"):
        toks = with_windows(toks, name, sizes)
    # One list after the other, each with a hash for every token.
    every = [F.col(f"{name}_{size}") for size in sizes for name in ("toks", "plain")]
    hashes = F.concat(*every) if every else F.array().cast("array<long>")
    met = toks.select("doc_id", F.size("toks").alias("n"), F.posexplode(hashes).alias("place", "hash")).join(names, "hash")
    return met.withColumn("doc_pos", F.col("place") % F.col("n")).drop("place", "n", "hash")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 8, min_share: float = 0.5, min_run: int = 20
) -> DataFrame:
    """doc_id, item_id, n_windows, share and exact for every item found in a document.

    ``exact`` is what stands there word for word: the whole item, or a long run of it and nothing else.
    """
    windows = materialise(item_windows(benchmark, window), "item_windows")
    met = hits(docs, windows)
    met = met.groupBy([c for c in met.columns if c != "literal"]).agg(F.max("literal").alias("literal"))
    met = materialise(met, "template_hits").withColumn("shift", F.col("doc_pos") - F.col("item_pos"))
    alignment = ["doc_id", "item_id", "shift"]
    at_once = met.where("whole").groupBy(*alignment, "n_windows").agg(F.countDistinct("item_pos").alias("n_found"))
    entire = at_once.where("n_found = n_windows").select(
        "doc_id", "item_id", F.col("n_windows").cast("long").alias("n_windows"), F.lit(1.0).alias("share"), F.lit(True).alias("exact")
    ).distinct()
    met = met.where("NOT whole").drop("n_windows", "whole")
    # Values along an alignment: the marked tokens of the item against those of the document.
    inside = met.select(
        *alignment, "item_pos", F.explode(F.sequence("item_pos", F.col("item_pos") + F.col("size") - 1)).alias("at")
    )
    places = inside.select(*alignment, "at").distinct()
    item_slots = _slots(benchmark, "item_id", "at", "item_value")
    in_items = places.join(item_slots, ["item_id", "at"]).withColumn("doc_pos", F.col("at") + F.col("shift"))
    wanted = in_items.select("doc_id").distinct()
    doc_slots = _slots(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi"), "doc_id", "doc_pos", "doc_value")
    pairs = in_items.join(doc_slots, ["doc_id", "doc_pos"]).select(*alignment, "at", "item_value", "doc_value").distinct()
    # How often the item's value stands for this one of the document, and how often it occurs.
    alike = F.count("*").over(Window.partitionBy(*alignment, "item_value", "doc_value"))
    there = F.count("*").over(Window.partitionBy(*alignment, "item_value"))
    pairs = materialise(pairs.withColumn("alike", alike).withColumn("there", there), "template_values")
    by_alignment = pairs.groupBy(*alignment).agg(
        F.countDistinct(F.when(F.col("alike") < F.col("there"), F.col("item_value"))).alias("n_clashing"),
        F.max((bare(F.col("item_value")) != bare(F.col("doc_value"))).cast("int")).alias("changed"),
    )
    merged = F.size(F.collect_set("doc_value")) < F.size(F.collect_set("item_value"))
    clashes = inside.join(pairs, [*alignment, "at"]).groupBy(*alignment, "item_pos").agg(
        (F.max(F.col("alike") * 2 <= F.col("there")) | merged).alias("clash")
    )
    in_row = Window.partitionBy(*alignment).orderBy("item_pos")
    literal = met.where("literal").select(*alignment, "item_pos", "size").distinct()
    literal = literal.withColumn("run", F.col("item_pos") - F.row_number().over(in_row))
    run_tokens = F.count("*").over(Window.partitionBy(*alignment, "run")) + F.col("size") - 1
    runs = literal.withColumn("tokens", run_tokens).where(F.col("tokens") >= min_run)
    judged = (
        met.join(clashes, [*alignment, "item_pos"], "left")
        .join(by_alignment, alignment, "left")
        .join(runs.select(*alignment, "item_pos", F.lit(True).alias("in_run")), [*alignment, "item_pos"], "left")
        .withColumn("in_run", F.coalesce("in_run", F.lit(False)))
    )
    agrees = ~F.coalesce("clash", F.lit(False)) | (F.col("literal") & (F.col("n_clashing") == 1)) | F.col("in_run")
    good = judged.where(agrees & (F.col("counted") | F.col("in_run")))
    totals = windows.where("NOT whole").select("item_id", "n_windows").distinct()
    found = good.groupBy("doc_id", "item_id").agg(
        F.countDistinct(F.when(F.col("counted"), F.col("item_pos"))).alias("n_found"),
        F.countDistinct(F.when(F.col("counted") & F.col("literal"), F.col("item_pos"))).alias("n_literal"),
        F.coalesce(F.max("changed"), F.lit(0)).alias("changed"),
        F.max("in_run").alias("in_run"),
    )
    share = F.col("n_found") / F.col("n_windows")
    exact = (F.col("changed") == 0) & (F.col("n_literal") == F.col("n_found")) & ((F.col("n_found") == F.col("n_windows")) | F.col("in_run"))
    return (
        found.join(totals, "item_id")
        .where((share >= min_share) | F.col("in_run"))
        .select("doc_id", "item_id", F.col("n_found").alias("n_windows"), share.alias("share"), exact.alias("exact"))
        .unionByName(entire)
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """The documents in which no item was found. Rows without a doc_id stay."""
    found = materialise(contaminated(docs, benchmark, **limits).select("doc_id").distinct(), "contaminated")
    return docs.join(broadcast_if_small(found), "doc_id", "left_anti").select(docs.columns)
