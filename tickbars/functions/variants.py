"""JSON texts read with their types kept: null when a value is of another type.

Texts are parsed once, by ``from_json``. Where a JSON string must not be mistaken for a
number, the field is read as VARIANT and its type is looked at; integers and booleans are
strict in ``from_json`` anyway. Keys may differ by case alone, so parsed structs are cast to
structs with plain names, which goes by position.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_JSON_TYPE = {"text": "variant", "integer": "bigint", "flag": "boolean"}


def json_type(fields: dict) -> str:
    """Struct type of a payload with ``fields`` = {key: (name, kind)}."""
    return "struct<" + ",".join(f"`{key}`:{_JSON_TYPE[kind]}" for key, (_, kind) in fields.items()) + ">"


def named_type(fields: dict) -> str:
    """The same struct with the column names."""
    return "struct<" + ",".join(f"{name}:{_JSON_TYPE[kind]}" for name, kind in fields.values()) + ">"


def kind(value: Column) -> Column:
    """Type name of a JSON value; null when the value is absent."""
    return F.schema_of_variant(value)


def as_text(value: Column) -> Column:
    """A JSON string; numbers and booleans do not count."""
    return F.when(kind(value) == "STRING", value.cast("string"))


def as_integer(value: Column) -> Column:
    return F.when(kind(value) == "BIGINT", value.cast("bigint"))


def as_number(value: Column) -> Column:
    """Any JSON number."""
    return F.when(~kind(value).isin("STRING", "BOOLEAN", "VOID"), F.try_variant_get(value, "$", "double"))


def as_flag(value: Column) -> Column:
    return F.when(kind(value) == "BOOLEAN", value.cast("boolean"))


def as_items(value: Column) -> Column:
    """A JSON array as array<variant>; null when it is none."""
    return F.try_variant_get(value, "$", "array<variant>")


def as_entries(value: Column) -> Column:
    """A JSON object as map<string, variant>; null when it is none."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def strict(fields: dict, struct: str | None = None) -> list[Column]:
    """Columns of a parsed payload, texts checked."""
    at = (lambda n: F.col(f"{struct}.{n}")) if struct else F.col
    return [(as_text(at(n)) if k == "text" else at(n)).alias(n) for n, k in fields.values()]


def unfold(fields: list[Column]) -> Column:
    """The fields as columns of their own, through a one-row generator.

    A filter on parsed fields would otherwise be pushed below the projection that computes
    them and repeat the parsing in every condition.
    """
    return F.inline(F.array(F.struct(*fields)))
