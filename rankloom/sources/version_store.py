"""A versioned table in files: an upsert rewrites the buckets it touches and nothing else.

Keys are dealt to ``buckets`` by hash. A bucket has one folder of current copies
(version 0) and some runs of history, which is only appended to; runs of one
bucket are merged by level, so they stay few. An upsert reads and rewrites the
current copies of the buckets that its keys fall in. Removing a key rewrites the
history of its bucket as well.

A manifest names the folders of each bucket. It is put in place only if no other
upsert came between, so readers see whole upserts and of two at once one fails.
Take more buckets for larger tables: a batch of few keys costs at most as many
buckets as it has keys.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankloom.operators.versions import DELETE, read_version, versioned_upsert
from rankloom.session import materialise
from rankloom.sources.commits import delete, names, put_if_absent, read_text
from rankloom.sources.run_store import merge_suffix

PART, BUCKET = "part_", "bucket_"


@dataclass(frozen=True)
class Layout:
    """Folders by bucket; those of history with their level, oldest first."""

    version: int = 0
    buckets: int = 0
    schema: str = ""
    current: dict[str, str] = field(default_factory=dict)
    history: dict[str, list[tuple[str, int]]] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)


class VersionStore:
    """The versioned table at ``root`` with one ``key`` column and the columns ``compare``."""

    def __init__(
        self, spark: SparkSession, root: str, key: str, compare: list[str], buckets: int = 64, fanout: int = 8, keep: int = 8
    ):
        self.spark, self.root, self.key, self.compare = spark, root.rstrip("/"), key, compare
        self.buckets, self.fanout, self.keep = buckets, fanout, keep

    def _numbers(self) -> list[int]:
        return [int(name) for name in names(self.spark, f"{self.root}/manifests")]

    def _path(self, version: int) -> str:
        return f"{self.root}/manifests/{version:012d}"

    def layout(self, version: int | None = None) -> Layout:
        version = version or max(self._numbers(), default=0)
        return Layout(**json.loads(read_text(self.spark, self._path(version)))) if version else Layout(buckets=self.buckets)

    def _bucket(self, layout: Layout):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(layout.buckets)).cast("int")

    def _read(self, layout: Layout, folders: list[str]) -> DataFrame | None:
        if not folders:
            return None
        schema = StructType.fromJson(json.loads(layout.schema))
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{folder}" for folder in folders])

    def _write(self, rows: DataFrame, parts: list[str]) -> dict[str, dict[str, str]]:
        """Write rows with their part and bucket; the folder of each."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.hint("rebalance", PART, BUCKET).write.partitionBy(PART, BUCKET).parquet(f"{self.root}/{folder}")
        return {
            part: {
                name.partition("=")[2]: f"{folder}/{PART}={part}/{name}"
                for name in names(self.spark, f"{self.root}/{folder}/{PART}={part}")
            }
            for part in parts
        }

    def _held(self, df: DataFrame, layout: Layout) -> list[str]:
        """The buckets of some keys: at most as many as there are."""
        return sorted(str(r[0]) for r in df.select(self._bucket(layout)).distinct().collect())

    def upsert(self, batch: DataFrame, marker: str | None = None, arrival: list[str] | None = None) -> int:
        """Apply ``versioned_upsert`` to the stored table; the number of the new state.

        It is an error if another upsert was committed meanwhile; nothing is changed then.
        """
        last = self.layout()
        batch = materialise(batch, "upsert")
        touched = self._held(batch, last)
        if not touched:
            return last.version
        none = F.lit(None).cast("long")
        nothing = batch.limit(0).select(self.key, *self.compare, F.lit(0).cast("long").alias("version"), none.alias("latest"))
        current = self._read(last, [last.current[b] for b in touched if b in last.current])
        rows = versioned_upsert(nothing if current is None else current, batch, self.key, self.compare, marker, arrival)
        schema = rows.schema.json()
        history = {bucket: [tuple(run) for run in runs] for bucket, runs in last.history.items()}
        dropped = [last.current[b] for b in touched if b in last.current]
        doomed = batch.where(F.col(marker) == DELETE).select(self.key).distinct() if marker else None
        thinned = [b for b in self._held(doomed, last) if history.get(b)] if marker else []
        if thinned:  # their history is written again without the removed keys
            old = [name for b in thinned for name, _ in history[b]]
            rows = rows.unionByName(self._read(last, old).join(doomed, self.key, "left_anti"))
            dropped += old
        part = F.when(F.col("version") == 0, "current").otherwise("history")
        written = self._write(rows.withColumn(PART, part).withColumn(BUCKET, self._bucket(last)), ["current", "history"])
        made = [*written["current"].values(), *written["history"].values()]
        kept = {b: name for b, name in last.current.items() if b not in touched}
        for b in thinned:
            level = max(level for _, level in history.pop(b))
            if b in written["history"]:
                history[b] = [(written["history"].pop(b), level)]
        for b, name in written["history"].items():
            history.setdefault(b, []).append((name, 0))
        merged, gone = self._merge(last, schema, history, list(written["history"]))
        made += merged
        state = Layout(last.version + 1, last.buckets, schema, {**kept, **written["current"]}, history, dropped + gone)
        if not put_if_absent(self.spark, self._path(state.version), json.dumps(vars(state))):
            for name in made:
                delete(self.spark, f"{self.root}/{name}")
            raise ValueError(f"{self.root} is not at state {last.version} any more")
        self._clean(state.version)
        return state.version

    def _merge(self, last: Layout, schema: str, history: dict, grown: list[str]) -> tuple[list[str], list[str]]:
        """Merge runs of the buckets that grew where enough of a level are there: new folders, old folders."""
        found = {b: merge_suffix([level for _, level in history[b]], self.fanout) for b in grown}
        found = {b: merge for b, merge in found.items() if merge is not None}
        if not found:
            return [], []
        old = [name for b, (start, _) in found.items() for name, _ in history[b][start:]]
        rows = self._read(Layout(buckets=last.buckets, schema=schema), old).withColumn(PART, F.lit("history"))
        new = self._write(rows.withColumn(BUCKET, self._bucket(last)), ["history"])["history"]
        for b, (start, level) in found.items():
            history[b][start:] = [(new[b], level)]
        return list(new.values()), old

    def _clean(self, newest: int) -> None:
        for version in self._numbers():
            if version <= newest - self.keep:
                for folder in self.layout(version).dropped:
                    delete(self.spark, f"{self.root}/{folder}")
                delete(self.spark, self._path(version))

    def read(self, version: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """Rows at a version (0: current copies), or all; of the given keys or all.

        Only the folders of current copies or of history are read, and only those of
        the buckets that the keys fall in.
        """
        last = self.layout()
        if not last.version:
            raise ValueError(f"nothing has been stored at {self.root} yet")
        buckets = None if keys is None else set(self._held(keys, last))
        wanted = lambda b: buckets is None or b in buckets
        folders = [name for b, name in last.current.items() if wanted(b)] if version in (None, 0) else []
        if version != 0:
            folders += [name for b, runs in last.history.items() if wanted(b) for name, _ in runs]
        rows = self._read(last, folders)
        if rows is None:
            return self.spark.createDataFrame([], StructType.fromJson(json.loads(last.schema)))
        if version is not None:
            return read_version(rows, version, keys)
        return rows if keys is None else rows.join(keys, keys.columns, "left_semi")
