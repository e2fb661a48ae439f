"""Equality filters with the strict typing of JSON values."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstone.errors import InvalidCommand
from loomstone.model import TableSpec


def _matches_type(kind: T.DataType, value: Any) -> bool:
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType)
    if isinstance(value, int):
        return isinstance(kind, T.IntegralType)
    if isinstance(value, float):
        return isinstance(kind, T.FractionalType)
    return isinstance(value, str) and isinstance(kind, T.StringType)


def canonical(value: Any) -> str:
    """JSON text with sorted members: equal values, equal text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def equals(field: T.StructField, value: Any) -> Column:
    """``field = value`` as JSON values compare: a string is never a number, 1 is never 1.0, null only equals null."""
    column = F.col(field.name)
    if isinstance(field.dataType, T.VariantType):
        return _variant_equals(column, value)
    if value is None:
        return column.isNull()
    if isinstance(value, list | dict):
        return F.to_json(column).eqNullSafe(F.lit(canonical(value))) if isinstance(field.dataType, T.StructType | T.ArrayType | T.MapType) else F.lit(False)
    return F.coalesce(column == F.lit(value), F.lit(False)) if _matches_type(field.dataType, value) else F.lit(False)


def _variant_equals(column: Column, value: Any) -> Column:
    """Against a variant: its own type must be the value's. A missing member (SQL null) equals nothing."""
    kind = F.schema_of_variant(column)
    if value is None:
        return F.coalesce(F.is_variant_null(column), F.lit(False))
    if isinstance(value, bool):
        wanted, got = kind == "BOOLEAN", F.try_variant_get(column, "$", "boolean") == F.lit(value)
    elif isinstance(value, int):
        wanted, got = kind == "BIGINT", F.try_variant_get(column, "$", "bigint") == F.lit(value)
    elif isinstance(value, float):
        wanted, got = kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), F.try_variant_get(column, "$", "double") == F.lit(value)
    elif isinstance(value, str):
        wanted, got = kind == "STRING", F.try_variant_get(column, "$", "string") == F.lit(value)
    else:
        # variants keep object members in order of their names, as canonical text does
        wanted, got = kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.to_json(column) == F.lit(canonical(value))
    return F.coalesce(wanted & got, F.lit(False))


def scalar_eq(rows: DataFrame, spec: TableSpec, wanted: Mapping[str, Any]) -> DataFrame:
    """Rows that satisfy every equality; each column must be a declared scalar."""
    for name in wanted:
        if name not in spec.scalars:
            raise InvalidCommand(f"field {name!r} is not a scalar column of {spec.name}")
    out = rows
    for name, value in wanted.items():
        out = out.where(equals(rows.schema[name], value))
    return out


def labels(wanted: Mapping[str, Any]) -> list[str]:
    """The filters as text for an explanation."""
    return [f"{name} = {canonical(value)}" for name, value in wanted.items()]
