"""JSON columns: round trips, comparison by value, paths, allowed keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_roundtrip(df: DataFrame, columns: list[str], schema: str, into: str = "decoded") -> DataFrame:
    """Adds ``json`` (the columns encoded) and ``into`` (decoded again)."""
    encoded = df.withColumn("json", F.to_json(F.struct(*columns)))
    return encoded.withColumn(into, F.from_json("json", schema))


def same_json(a: Column, b: Column, schema: str) -> Column:
    """Equal by decoded value: key order and spacing do not matter."""
    return F.from_json(a, schema).eqNullSafe(F.from_json(b, schema))


def whole_number(value: Column) -> Column:
    """A decimal as a long if it is whole, else null."""
    return F.when(value == F.floor(value), value.cast("long"))


def fractional_number(value: Column) -> Column:
    """A decimal as a double if it is not whole, else null."""
    return F.when(value != F.floor(value), value.cast("double"))


def json_paths(df: DataFrame, json_col: str, paths: dict[str, str | list[str]]) -> DataFrame:
    """Adds one text column per path; a list of paths takes the first present."""
    columns = {}
    for name, path in paths.items():
        choices = [path] if isinstance(path, str) else path
        columns[name] = F.coalesce(*[F.get_json_object(json_col, p) for p in choices])
    return df.withColumns(columns)


def json_list(text: Column, path: str, where: Callable[[Column], Column] | None = None) -> Column:
    """The present values at a path with ``[*]`` steps, as one flat array.

    ``$.solutions[*].campaigns[*].name`` opens each list in turn; an absent
    list gives an empty array. ``where`` judges the entries of the last list, as
    JSON text, and only those it holds for are kept.
    """
    *lists, last = path.removeprefix("$").split("[*]")
    found = F.array(text)
    for step in lists:
        found = F.flatten(F.transform(found, _opened(f"${step}")))
    if where is not None:
        found = F.filter(found, where)
    if last:
        found = F.transform(found, lambda entry: F.get_json_object(entry, f"${last}"))
    return F.filter(found, lambda value: value.isNotNull())


def _opened(path: str):
    none = F.array().cast("array<string>")
    return lambda entry: F.coalesce(F.from_json(F.get_json_object(entry, path), "array<string>"), none)


def bad_keys(text: Column, allowed: dict, prefix: Column | None = None) -> Column:
    """Paths of keys outside ``allowed``: a tree of key -> None (anything), a
    dict (object), or a list holding a dict (list of objects)."""
    prefix = F.lit("") if prefix is None else prefix
    none = F.array().cast("array<string>")
    keys = F.coalesce(F.json_object_keys(text), none)
    odd = F.array_except(keys, F.array(*[F.lit(k) for k in allowed]))
    found = [F.transform(odd, lambda key: F.concat(prefix, key))]
    for key, below in allowed.items():
        if not below:
            continue
        child = F.get_json_object(text, f"$.{key}")
        if isinstance(below, dict):
            found.append(bad_keys(child, below, F.concat(prefix, F.lit(f"{key}."))))
        else:
            entries = F.coalesce(F.from_json(child, "array<string>"), none)
            found.append(F.flatten(F.transform(entries, _entry_check(below[0], prefix, key))))
    return F.concat(*found)


def _entry_check(allowed: dict, prefix: Column, key: str):
    def check(entry: Column, place: Column) -> Column:
        return bad_keys(entry, allowed, F.concat(prefix, F.lit(f"{key}["), place.cast("string"), F.lit("].")))

    return check


def unexpected_keys(df: DataFrame, json_col: str, allowed: dict, id: str) -> DataFrame:
    """One row per key outside the allowed tree: id, key."""
    return df.select(id, F.explode(bad_keys(F.col(json_col), allowed)).alias("key"))
