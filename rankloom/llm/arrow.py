"""Small helpers around ``mapInArrow``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from rankloom.session import ship_package

ROWS = 1024
_LIMIT = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(spark: SparkSession) -> None:
    """Rows hold whole texts and sets, so the session's Arrow batches get few of them; a lower limit stays."""
    if not 0 < int(spark.conf.get(_LIMIT)) <= ROWS:
        spark.conf.set(_LIMIT, str(ROWS))


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that what is made of a batch stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_batches(
    df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[list]], schema: StructType | str
) -> DataFrame:
    """Apply ``work`` per partition; it yields one list per column of ``schema`` at a time."""
    ship_package(df.sparkSession)
    short_batches(df.sparkSession)
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    target = to_arrow_schema(schema)

    def run(batches):
        for columns in work(slices(batches)):
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, target)],
                schema=target,
            )

    return df.mapInArrow(run, schema)
