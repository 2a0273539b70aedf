"""The engine's field types and their Spark forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: field types, then the Python annotations and cast names that mean them
FIELD_TYPES = ("str", "f64", "i64", "bool", "bytes", "datetime", "json")
OF_ANNOTATION = {str: "str", int: "i64", float: "f64", bool: "bool", bytes: "bytes"}
OF_CAST = {"str": "str", "int": "i64", "float": "f64", "bool": "bool"}
SPARK = {"str": T.StringType(), "f64": T.DoubleType(), "i64": T.LongType(), "bool": T.BooleanType(), "bytes": T.BinaryType(), "datetime": T.TimestampType(), "json": T.StringType()}


def field_type(kind: T.DataType) -> str:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "i64"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "f64"
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, (T.StringType, T.NullType)):
        return "str"
    if isinstance(kind, T.BinaryType):
        return "bytes"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "json"


def schema_of(schema: T.StructType) -> dict[str, str]:
    return {f.name: field_type(f.dataType) for f in schema.fields}


def normal(c: Column, kind: str) -> Column:
    """A column in the one Spark type of its field type."""
    return c.cast(SPARK[kind]) if kind in ("i64", "f64") else c


def millis(c: Column) -> Column:
    """Epoch milliseconds of a timestamp with or without zone (session zone UTC), rounded down."""
    return F.unix_millis(c.cast("timestamp"))


def is_nan(c: Column, kind: str) -> Column:
    return F.isnan(c) if kind == "f64" else F.lit(False)
