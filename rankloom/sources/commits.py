"""Small files that are committed once: of several writers one succeeds, readers see all or nothing."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.makeQualified(place), files


def _is(error: Py4JJavaError, kind: str) -> bool:
    return error.java_exception.getClass().getName().endswith(kind)


def _link(spark: SparkSession, draft, target) -> None:
    paths = spark._jvm.java.nio.file.Paths
    spark._jvm.java.nio.file.Files.createLink(paths.get(target.toUri()), paths.get(draft.toUri()))


def _rename(spark: SparkSession, draft, target) -> None:
    kinds = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    only_new = spark.sparkContext._gateway.new_array(kinds, 1)
    only_new[0] = kinds.NONE
    context = spark._jvm.org.apache.hadoop.fs.FileContext
    context.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(draft, target, only_new)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write ``text`` to ``path`` unless something is there; False if it is.

    The text is written to a draft, which then gets the name in one step that
    fails if the name is taken: a hard link on plain files, a rename without
    overwriting elsewhere. The latter is atomic where the store renames
    atomically, as HDFS does; keep commits there if the data lie in a store that
    does not.
    """
    target, files = _place(spark, path)
    draft, _ = _place(spark, f"{target.getParent()}/_draft-{uuid.uuid4().hex}")
    stream = files.create(draft, True)
    stream.write(text.encode())
    stream.close()
    take = _link if target.toUri().getScheme() == "file" else _rename
    try:
        take(spark, draft, target)
        return True
    except Py4JJavaError as error:
        if _is(error, "FileAlreadyExistsException"):
            return False
        raise
    finally:
        files.delete(draft, False)


def read_text(spark: SparkSession, path: str) -> str:
    place, files = _place(spark, path)
    stream = files.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder, drafts left out; nothing if it is not there."""
    place, files = _place(spark, folder)
    try:
        found = [status.getPath().getName() for status in files.listStatus(place)]
    except Py4JJavaError as error:
        if _is(error, "FileNotFoundException"):
            return []
        raise
    return sorted(name for name in found if not name.startswith(("_", ".")))


def delete(spark: SparkSession, path: str) -> None:
    place, files = _place(spark, path)
    files.delete(place, True)
