"""CSV datasets: one file or a folder of parts, bound to a declared schema."""

from __future__ import annotations

import csv
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.session import materialise
from rankloom.sources.commits import names, put_if_absent, read_text
from rankloom.sources.csv_records import records
from rankloom.sources.schemas import spark_schema

CORRUPT = "_corrupt_line"


def list_files(spark: SparkSession, root: str, suffix: str = ".csv") -> DataFrame:
    """Files with the suffix directly inside ``root`` (or ``root`` itself):
    path, modified. A listing only; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(root)
    return files.select("path", F.col("modificationTime").alias("modified"))


def newest_file(spark: SparkSession, root: str, suffix: str = ".csv") -> DataFrame:
    """The newest matching file, one row path, modified; ties by path; no row
    if there is none."""
    return list_files(spark, root, suffix).orderBy(F.col("modified").desc(), "path").limit(1)


def newest_rows(spark: SparkSession, root: str, avro_json: str | dict, suffix: str = ".csv") -> DataFrame:
    """Good rows of the newest matching file below ``root``; none if there is no file."""
    newest = newest_file(spark, root, suffix).first()
    return import_csv(spark, root if newest is None else newest.path, avro_json)[0]


def deliver_csv(df: DataFrame, root: str) -> int:
    """Write ``df`` below ``root`` as a delivery of as many part files as Spark makes; its number.

    The delivery is there once its number is committed. Numbers follow one
    another, so the newest delivery needs no clock.
    """
    spark, folder = df.sparkSession, f"deliveries/{uuid.uuid4().hex}"
    options = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "emptyValue": ""}
    df.write.options(header=True, **options).csv(f"{root}/{folder}")
    while True:
        number = _newest_number(spark, root) + 1
        if put_if_absent(spark, f"{root}/commits/{number:012d}", folder):
            return number


def _newest_number(spark: SparkSession, root: str) -> int:
    return max(map(int, names(spark, f"{root}/commits")), default=0)


def newest_delivery(spark: SparkSession, root: str, avro_json: str | dict) -> DataFrame:
    """Good rows of the newest delivery below ``root``, whatever number of files it has."""
    number = _newest_number(spark, root)
    if not number:
        raise ValueError(f"nothing has been delivered to {root} yet")
    folder = read_text(spark, f"{root}/commits/{number:012d}")
    return import_csv(spark, f"{root}/{folder}", avro_json)[0]


def _exists(spark: SparkSession, path: str, suffix: str) -> bool:
    try:
        return not list_files(spark, path, suffix).isEmpty()
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return False
        raise


def locate(spark: SparkSession, root: str, dataset: str) -> str | None:
    """``<root>/<dataset>/`` if CSV parts lie directly inside, else
    ``<root>/<dataset>.csv``, else None: a dataset may be absent."""
    folder, single = f"{root}/{dataset}", f"{root}/{dataset}.csv"
    if _exists(spark, folder, ".csv"):
        return folder
    return single if _exists(spark, single, ".csv") else None


def _heads(lines: DataFrame) -> DataFrame:
    """file, header, head_place: the first record of every file."""
    first = F.min(F.struct("place", "value")).alias("first")
    return lines.where("part = 0").groupBy("file").agg(first).select(
        "file", F.col("first.value").alias("header"), F.col("first.place").alias("head_place")
    )


def import_csv(spark: SparkSession, path: str, avro_json: str | dict) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of a CSV file or folder with a declared schema.

    Columns are bound by name, by the header of each file. The records of all
    files are read as one table that takes the header of its file by a join, so
    neither a list of files nor a file has to pass through one place; only the
    distinct headers reach the driver. Quoted fields may hold commas, line breaks
    and doubled quotes; lines end with LF or CRLF. A row is bad if its record has
    too few or too many fields, if a field does not parse, or if one that must be
    there is empty; ``bad`` holds the raw fields and the record in ``_corrupt_line``.

    Fields are read as text and cast here, so which rows are bad never depends
    on the columns a later step happens to use.
    """
    declared = spark_schema(avro_json)
    names = declared.fieldNames()
    lines = records(spark, path)
    heads = materialise(_heads(lines), "csv-heads")
    fields = None
    for row in heads.select("header").distinct().orderBy("header").collect():
        order = [name.strip() for name in next(csv.reader([row.header.lstrip("\ufeff")]))]
        if sorted(order) != sorted(names):
            raise ValueError(f"header {order} does not hold the declared columns {names}")
        layout = ", ".join(f"`{name}` string" for name in [*order, CORRUPT])
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "escape": '"'}
        read = F.from_csv("value", layout, options)
        same = F.struct(*[read[name].alias(name) for name in [*names, CORRUPT]])
        fields = F.when(F.col("header") == row.header, same) if fields is None else fields.when(F.col("header") == row.header, same)
    if fields is None:
        fields = F.struct(*[F.lit(None).cast("string").alias(name) for name in [*names, CORRUPT]])
    is_head = F.coalesce(F.col("place") == F.col("head_place"), F.lit(False)) & (F.col("part") == 0)
    body = lines.join(heads, "file").where(~is_head).where(F.trim("value") != "")
    rows = body.select(fields.alias("row")).select("row.*")

    wrong = F.col(CORRUPT).isNotNull()
    for field in declared.fields:
        unparsed = F.col(field.name).isNotNull() & F.col(field.name).try_cast(field.dataType).isNull()
        wrong = wrong | (unparsed if field.nullable else unparsed | F.col(field.name).isNull())
    typed = [F.col(f.name).try_cast(f.dataType).alias(f.name, metadata=f.metadata) for f in declared.fields]
    whole_line = F.coalesce(F.col(CORRUPT), F.to_csv(F.struct(*names), {"escape": '"'}))
    return rows.where(~wrong).select(*typed), rows.where(wrong).withColumn(CORRUPT, whole_line)


def resolve_parts(spark: SparkSession, root: str, dataset: str, avro_json: str | dict) -> DataFrame | None:
    """Good rows of a dataset wherever it lies below ``root``; None if absent."""
    path = locate(spark, root, dataset)
    return None if path is None else import_csv(spark, path, avro_json)[0]
