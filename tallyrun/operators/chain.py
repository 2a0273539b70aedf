"""Stateless row operators on DataFrames."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import RegistrationError
from ..functions.expr import ExprError, cast_column, compile_expr
from ..functions.types import OF_CAST, SPARK

#: columns of the engine's own, which no operator touches
RESERVED = "_tr_"


def _bad(message: str) -> RegistrationError:
    return RegistrationError("invalid_expression", message)


def _known(cols, schema: dict[str, str]) -> None:
    for c in cols:
        if c not in schema:
            raise _bad(f"unknown field {c!r}")


def apply(df: DataFrame, steps, schema: dict[str, str]) -> tuple[DataFrame, dict[str, str]]:
    """Run a chain; the schema holds the user's fields, in order."""
    own = [c for c in df.columns if c.startswith(RESERVED)]
    schema = dict(schema)
    for op, payload in steps:
        try:
            df, schema = _STEPS[op](df, payload, schema, own)
        except ExprError as e:
            raise _bad(str(e)) from e
    return df, schema


def propagate(steps, schema: dict[str, str], spark) -> dict[str, str]:
    """The schema after a chain, without data."""
    empty = spark.createDataFrame([], _struct(schema))
    return apply(empty, steps, schema)[1]


def _struct(schema: dict[str, str]):
    from pyspark.sql import types as T

    return T.StructType([T.StructField(k, SPARK[v]) for k, v in schema.items()])


def _q(name: str):
    return F.col(f"`{name}`")


def _filter(df, e, schema, own):
    c, kind = compile_expr(e, schema)
    if kind != "bool":
        raise _bad(f"filter takes bool, got {kind}")
    return df.filter(c), schema  # null drops the row as false does, and the bare condition reaches the scan


def _select(df, cols, schema, own):
    _known(cols, schema)
    return df.select(*map(_q, cols), *own), {c: schema[c] for c in cols}


def _drop(df, cols, schema, own):
    _known(cols, schema)
    left = [c for c in schema if c not in cols]
    return df.select(*map(_q, left), *own), {c: schema[c] for c in left}


def _rename(df, mapping: dict[str, str], schema, own):
    """All at once, so names can be swapped."""
    _known(mapping, schema)
    names = [mapping.get(c, c) for c in schema]
    if len(set(names)) < len(names):
        raise _bad(f"rename gives a name twice: {sorted(n for n in set(names) if names.count(n) > 1)}")
    return df.select(*[_q(c).alias(mapping.get(c, c)) for c in schema], *own), {mapping.get(c, c): k for c, k in schema.items()}


def _with_columns(df, exprs: dict[str, Any], schema, own):
    """In order of names, each seeing those before."""
    schema = dict(schema)
    for name in sorted(exprs):
        if name.startswith(RESERVED):
            raise _bad(f"{name!r} is reserved")
        c, kind = compile_expr(exprs[name], schema)
        df = df.withColumn(name, c)
        schema[name] = kind
    return df, schema


def _cast(df, types: dict[str, str], schema, own):
    _known(types, schema)
    out = [(cast_column(_q(c), k, types[c]).alias(c) if c in types else _q(c)) for c, k in schema.items()]
    return df.select(*out, *own), {c: OF_CAST[types[c]] if c in types else k for c, k in schema.items()}


def _fillna(df, defaults: dict[str, Any], schema, own):
    _known(defaults, schema)
    out = []
    for c, kind in schema.items():
        v = defaults.get(c)
        out.append(F.coalesce(_q(c), F.lit(v).cast(SPARK[kind])).alias(c) if c in defaults and not isinstance(v, (list, dict, tuple, set)) else _q(c))
    return df.select(*out, *own), schema


_STEPS = {"filter": _filter, "select": _select, "drop": _drop, "rename": _rename, "with_columns": _with_columns, "cast": _cast, "fillna": _fillna}
