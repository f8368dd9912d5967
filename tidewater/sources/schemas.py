"""Schemas in short form: ts:ts,symbol:str,price:f64."""

from __future__ import annotations

from pyspark.sql import types as T

#: Types of the short form (fixed values).
TYPES = {"i64": T.LongType(), "i32": T.IntegerType(), "f64": T.DoubleType(), "bool": T.BooleanType(), "str": T.StringType(), "cat": T.StringType(), "date": T.DateType(), "ts": T.TimestampType()}


def parse_schema(text: str) -> T.StructType:
    out = T.StructType()
    for part in text.split(","):
        name, _, kind = part.partition(":")
        if not name.strip() or kind.strip() not in TYPES:
            raise ValueError(f"not name:type: {part!r}")
        out.add(name.strip(), TYPES[kind.strip()])
    return out


def time_column(schema: T.StructType) -> str | None:
    """The first date or timestamp column, which is the time index of a stream."""
    return next((f.name for f in schema if isinstance(f.dataType, (T.DateType, T.TimestampType))), None)
