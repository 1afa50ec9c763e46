"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import pathlib
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_shipped: set[str] = set()
_shipping = threading.Lock()
_paths: list[str] = []


def prepare(spark: SparkSession) -> SparkSession:
    """All event times are UTC; nothing else of the session is changed."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once per application.

    Spark copies the archive to the executors, so they need no path of the driver.
    """
    sc = spark.sparkContext
    with _shipping:  # threads of one application that need it at the same time add it once
        if sc.applicationId in _shipped:
            return
        here = pathlib.Path(__file__).parent
        archive = pathlib.Path(tempfile.mkdtemp(prefix="rankloom-")) / "rankloom.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(here.rglob("*.py")):
                out.write(file, pathlib.Path(here.name) / file.relative_to(here))
        sc.addPyFile(str(archive))
        _shipped.add(sc.applicationId)


def workspace(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where it is unset, as in a quick local run, a local session gets a fresh
    temporary folder. A cluster must name one, since a machine-local folder is
    lost with its machine.
    """
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="rankloom-"))
    return sc.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    path = f"{workspace(spark)}/rankloom/{name}-{uuid.uuid4().hex}"
    _paths.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that the block writes to the shared folder when it ends.

    Results have to be written elsewhere inside the block, as they read those tables.
    """
    first = len(_paths)
    try:
        yield
    finally:
        mine, _paths[first:] = _paths[first:], []
        for path in mine:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result feeds several later stages: the table survives lost
    executors, is columnar, and gives the planner its true size. Spark deletes the
    shuffle files of the write when it is done, so they do not pile up over a job.
    """
    path, conf = fresh_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(CLEAN_UP, "false")
    conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(CLEAN_UP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
