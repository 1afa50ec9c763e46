"""Declared schemas: an Avro record, given as JSON, as a Spark schema."""

from __future__ import annotations

import json

from pyspark.sql import types as T

# The accepted column types.
TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
}


def spark_schema(avro_json: str | dict) -> T.StructType:
    """The schema of one flat record; ``categorical`` is kept as metadata, and a
    union with ``null`` makes a field nullable."""
    record = json.loads(avro_json) if isinstance(avro_json, str) else avro_json
    if record.get("type") != "record" or not record.get("fields"):
        raise ValueError("a schema must be a record with fields")
    return T.StructType([_field(f) for f in record["fields"]])


def _field(field: dict) -> T.StructField:
    declared = field["type"]
    nullable = isinstance(declared, list)
    names = [t for t in declared if t != "null"] if nullable else [declared]
    if len(names) != 1 or not isinstance(names[0], str) or names[0] not in TYPES:
        raise ValueError(f"field {field['name']} has an unsupported type {declared}")
    metadata = {"categorical": True} if field.get("categorical") else {}
    return T.StructField(field["name"], TYPES[names[0]], nullable, metadata)
