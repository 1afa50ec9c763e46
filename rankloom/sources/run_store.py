"""A table that grows by small batches and is read from few folders.

Each batch is written as a run. Whenever ``fanout`` runs of one level are there,
they become one run of the next level, so n batches lie in at most about
``fanout`` * log(n) runs and a row is rewritten log(n) times. Rows of a key are
folded when runs are merged and when they are read (counts add up, the earliest
stays), so nothing has to be looked up when a batch comes in.

A manifest names the live runs and, for each writer, its last batch. The next
manifest is put in place only if nobody else did so; a batch that is run again is
found there and changes nothing. Manifests and the runs they dropped stay for
``keep`` more batches, for readers that have begun.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankloom.sources.commits import delete, names, put_if_absent, read_text

FOLDS = {"sum": F.sum, "min": F.min, "max": F.max}


def merge_suffix(levels: list[int], fanout: int) -> tuple[int, int] | None:
    """Which runs to merge now, oldest first and levels falling: the place of the first
    of them, up to the newest, and the level of the result. None if there is nothing to do."""
    start, level, made = len(levels), levels[-1] if levels else 0, 0
    while True:
        first = start
        while first and levels[first - 1] == level:
            first -= 1
        if start - first + made < fanout:
            return (start, level) if made else None
        start, level, made = first, level + 1, 1


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    runs: list[tuple[str, int]] = field(default_factory=list)  # folder, level; oldest first
    done: dict[str, int] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)
    schema: str = ""


class RunStore:
    """Rows of ``keys`` and of the columns in ``folds`` (sum, min or max by key).

    Without ``folds`` rows are kept as they are. ``partition`` columns cut every run.
    """

    def __init__(
        self, spark: SparkSession, root: str, keys: list[str], folds: dict[str, str] | None = None,
        partition: tuple[str, ...] = (), fanout: int = 8, keep: int = 8,
    ):
        self.spark, self.root, self.keys, self.folds = spark, root.rstrip("/"), keys, folds or {}
        self.partition, self.fanout, self.keep = partition, fanout, keep

    def _versions(self) -> list[int]:
        return [int(name) for name in names(self.spark, f"{self.root}/manifests")]

    def _path(self, version: int) -> str:
        return f"{self.root}/manifests/{version:012d}"

    def manifest(self, version: int | None = None) -> Manifest:
        """The newest manifest, or one by number; an empty one if there is none yet."""
        version = version or max(self._versions(), default=0)
        return Manifest(**json.loads(read_text(self.spark, self._path(version)))) if version else Manifest()

    def _folded(self, rows: DataFrame) -> DataFrame:
        if not self.folds:
            return rows
        return rows.groupBy(*self.keys).agg(*[FOLDS[fold](name).alias(name) for name, fold in self.folds.items()])

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        read = self.spark.read.schema(StructType.fromJson(json.loads(schema))).option("basePath", f"{self.root}/runs")
        return self._folded(read.parquet(*[f"{self.root}/{folder}" for folder in folders]).drop("_run"))

    def _write(self, rows: DataFrame) -> str:
        folder = f"runs/_run={uuid.uuid4().hex}"
        rows.write.partitionBy(*self.partition).parquet(f"{self.root}/{folder}")
        return folder

    def add(self, rows: DataFrame, number: int, writer: str = "") -> bool:
        """Store batch ``number`` of ``writer``; False if it has been stored before."""
        if self.manifest().done.get(writer, -1) >= number:
            return False
        rows = self._folded(rows)
        schema, folder = rows.schema.json(), self._write(rows)
        while True:
            last = self.manifest()
            if last.done.get(writer, -1) >= number:  # the same batch elsewhere was quicker
                delete(self.spark, f"{self.root}/{folder}")
                return False
            runs, dropped = [*map(tuple, last.runs), (folder, 0)], []
            merge = merge_suffix([level for _, level in runs], self.fanout)
            if merge is not None:
                start, level = merge
                dropped = [name for name, _ in runs[start:]]
                merged = self._read(dropped, schema)
                merged = merged if self.folds else merged.hint("rebalance", *self.partition)
                runs[start:] = [(self._write(merged), level)]
            next_one = Manifest(last.version + 1, runs, {**last.done, writer: number}, dropped, schema)
            if put_if_absent(self.spark, self._path(next_one.version), json.dumps(vars(next_one))):
                self._clean(next_one.version)
                return True
            if merge is not None:
                delete(self.spark, f"{self.root}/{runs[-1][0]}")

    def _clean(self, newest: int) -> None:
        for version in self._versions():
            if version <= newest - self.keep:
                for folder in self.manifest(version).dropped:
                    delete(self.spark, f"{self.root}/{folder}")
                delete(self.spark, self._path(version))

    def read(self) -> DataFrame | None:
        """All rows stored so far, folded by key; None if no batch has been stored."""
        last = self.manifest()
        return self._read([folder for folder, _ in last.runs], last.schema) if last.version else None
