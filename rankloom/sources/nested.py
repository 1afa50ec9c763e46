"""Nested JSON documents as flat child tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten_documents(df: DataFrame, json_col: str, schema: str | T.StructType, id: str | list[str]) -> dict[str, DataFrame]:
    """A table per list of objects in the documents, named by its path.

    ``root`` holds the plain fields of the document. A child table holds the
    document's ``id``, the position in every list on the way, and the plain
    fields of the entry; objects inside are opened with dotted names.
    """
    ids = [id] if isinstance(id, str) else list(id)
    parsed = df.select(*ids, F.from_json(json_col, schema).alias("doc"))
    tables: dict[str, DataFrame] = {}
    _collect(parsed, parsed.schema["doc"].dataType, ids, "", tables)
    return tables


def _collect(df: DataFrame, kind: T.StructType, ids: list[str], path: str, tables: dict[str, DataFrame]) -> None:
    plain, lists = _fields(kind, "doc", "")
    tables[path or "root"] = df.select(*ids, *[F.col(source).alias(name) for source, name in plain])
    for source, name, entry in lists:
        below = f"{path}.{name}" if path else name
        place = f"{name}_pos"
        children = df.select(*ids, F.posexplode(F.col(source)).alias(place, "doc"))
        _collect(children, entry, [*ids, place], below, tables)


def _fields(kind: T.StructType, source: str, name: str):
    """Plain fields (source, name) and lists of objects (source, name, type)."""
    plain, lists = [], []
    for field in kind.fields:
        inner, label = f"{source}.{field.name}", f"{name}.{field.name}" if name else field.name
        if isinstance(field.dataType, T.StructType):
            more_plain, more_lists = _fields(field.dataType, inner, label)
            plain += more_plain
            lists += more_lists
        elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StructType):
            lists.append((inner, label, field.dataType.elementType))
        else:
            plain.append((inner, label))
    return plain, lists
